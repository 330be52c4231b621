"""Oracle SQL (DuckDB) for scoring and evaluation queries."""

from __future__ import annotations

from ..functions import catalog as K
from ..operators.score import LINEAR_SCORER
from .oracle_features import round_sql
from .roles_sql import with_roles

D = K.REQUEST_DEFAULTS


def n(k):
    return f"coalesce(CAST({k} AS DOUBLE), CAST({float(D[k])} AS DOUBLE))"


def b(k):
    return f"coalesce({k}, {'true' if D[k] else 'false'})"


def fl(pred):
    return f"CAST(coalesce({pred}, false) AS INTEGER)"


def _sdiv(a, c):
    return f"(CASE WHEN ({c}) = 0 THEN NULL ELSE ({a}) / ({c}) END)"


LR, ML, U = n("late_payment_rate"), n("max_days_late"), n("cc_utilization")
AI, LA = n("annual_income"), n("loan_amount")
FEAT_SQL = {
    "income_total": AI, "credit_amount": LA, "annuity_amount": n("monthly_payment"),
    "credit_to_income": _sdiv(LA, f"{AI} + 1"),
    "annuity_to_income": _sdiv(f"{n('monthly_payment')} * 12", f"{AI} + 1"),
    "income_per_person": _sdiv(AI, f"{n('family_size')} + 1"),
    "credit_per_month": _sdiv(LA, f"{n('loan_term')} + 1"),
    "installment_rate_pct": n("dti"), "debt_ratio": f"{n('dti')} / 100",
    "loan_amount_to_goods": _sdiv(LA, f"{LA} * 1.05 + 1"), "credit_to_goods": _sdiv(LA, f"{LA} * 1.05 + 1"),
    "has_savings": fl(b("has_savings")), "savings_above_500": fl(f"{n('savings_amount')} > 500"),
    "has_checking_account": fl(b("has_checking")),
    "checking_account_ordinal": n("checking_tier"), "savings_account_ordinal": n("savings_tier"),
    "docs_submission_rate": n("docs_rate"),
    "ext_source_count": f"CASE WHEN {b('is_new_user')} THEN 0 ELSE 2 END",
    "ext_source_mean": f"CASE WHEN {b('is_new_user')} THEN NULL ELSE 0.55 END",
    "stability_score": f"{n('checking_tier')} + {n('savings_tier')} + {n('employment_stability')} + {fl(b('owns_property'))}",
    "inst_late_payment_rate": LR, "inst_on_time_rate": f"1 - {LR}",
    "inst_payment_consistency": _sdiv("1", f"{LR} + 0.01"),
    "inst_days_late_max": ML, "inst_payment_ratio_mean": f"1 - {LR} * 0.3", "inst_payment_ratio_std": f"{LR} * 0.2",
    "inst_early_payment_rate": f"greatest(CAST(0 AS DOUBLE), 0.1 - {LR})", "inst_days_late_mean": f"{ML} * 0.4",
    "pos_dpd_rate": f"{LR} * 0.5", "pos_dpd_occurrences": f"{LR} * 24", "pos_sk_dpd_max": ML,
    "pos_completion_ratio": f"1 - {LR} * 0.3", "cc_payment_rate_mean": f"1 - {LR} * 0.5",
    "cc_payment_rate_std": f"{LR} * 0.1", "cc_dpd_mean": f"{ML} * 0.2", "cc_dpd_max": ML,
    "cc_utilization_mean": U, "cc_utilization_max": f"least({U} * 1.3, CAST(1 AS DOUBLE))",
    "cc_drawing_rate_mean": f"{U} * 0.8", "cc_atm_to_total_drawing": "0.2",
    "credit_history_ordinal": n("credit_history"), "has_past_delays": fl(b("has_past_delays")),
    "has_critical_account": fl(f"{ML} > 60"),
    "has_loan_history": f"CASE WHEN {b('is_new_user')} THEN 0 ELSE 1 END",
    "prev_approval_rate": n("approval_rate"), "prev_refusal_rate": f"1 - {n('approval_rate')}",
    "prev_total_applications": n("prev_applications"),
    "bureau_debt_to_credit_ratio": f"{n('dti')} / 100", "bureau_credit_day_overdue_max": ML,
    "bureau_bad_status_months": f"trunc({LR} * 24)", "bureau_credit_sum_overdue": f"{LA} * {LR} * 0.1",
    "bureau_dpd_months_mean": f"{LR} * 3",
    "bureau_active_credit_ratio": f"least({n('existing_credits')} / 10, CAST(1 AS DOUBLE))",
    "age_years": n("age"), "employment_years": n("employment_years"),
    "employed_flag": fl(b("employed")), "is_employed": fl(b("employed")),
    "employment_stability": n("employment_stability"), "senior_employee": fl(f"{n('employment_years')} >= 4"),
    "own_realty_flag": fl(b("owns_property")), "owns_house": fl(b("owns_property")),
    "owns_property": fl(b("owns_property")), "own_car_flag": "0", "family_members": n("family_size"),
    "children_count": f"greatest(CAST(0 AS DOUBLE), {n('family_size')} - 1)", "has_telephone": "1",
    "region_rating": n("region_rating"), "live_work_same_region": "1",
    "existing_credits_count": n("existing_credits"), "total_enquiries": n("enquiries"),
    "recent_enquiries_1yr": n("enquiries"),
    "loan_purpose_high_risk": fl(b("high_risk_purpose")), "loan_purpose_encoded": fl(b("high_risk_purpose")),
    "has_guarantor": fl(b("has_guarantor")), "has_co_applicant": "0",
    "has_other_installments": fl(f"{n('existing_credits')} > 0"), "other_install_bank": "0",
    "name_contract_type": "0",
}


def _features_select() -> str:
    cols = ["request_id"] + [f"CAST({FEAT_SQL[f]} AS DOUBLE) AS {f}" if f in FEAT_SQL
                             else f"CAST(NULL AS DOUBLE) AS {f}" for f in K.ALL_FEATURES]
    return "SELECT " + ", ".join(cols) + " FROM score_requests"


def _prob_sql(src="af") -> str:
    z = f"{LINEAR_SCORER['intercept']}"
    for k, w in LINEAR_SCORER.items():
        if k != "intercept":
            z += f" + {w} * coalesce({src}.{k}, 0)"
    return f"1 / (1 + exp(-({z})))"


def _score_sql(p):
    pc = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    od = f"least(greatest(ln((1 - {pc}) / {pc}), -4), 4)"
    return f"CAST(round_even({K.SCORE_MIN} + ({od} + 4) / 8 * ({K.SCORE_MAX} - {K.SCORE_MIN}), 0) AS INTEGER)"


def _band_sql(s):
    return "CASE " + " ".join(f"WHEN {s} >= {t} THEN '{nm}'" for t, nm in K.BANDS) + f" ELSE '{K.BAND_FLOOR}' END"


def _rec_sql(s):
    return "CASE " + " ".join(f"WHEN {s} >= {t} THEN '{nm}'" for t, nm in K.RECOMMENDATIONS) + \
        f" ELSE '{K.RECOMMENDATION_FLOOR}' END"


def _scored_ctes() -> str:
    return with_roles("score_requests", extra=[
        ("af", _features_select()),
        ("pr", f"SELECT af.request_id, {_prob_sql()} AS p FROM af"),
        ("sc", f"SELECT request_id, p, {_score_sql('p')} AS credit_score FROM pr"),
        ("scored", f"SELECT request_id, p, credit_score, {_band_sql('credit_score')} AS score_band, "
                   f"round_even(p * 100, 2) AS default_probability_pct, {_rec_sql('credit_score')} AS recommendation, "
                   f"'success' AS status FROM sc"),
    ])


def _fmt(x, places):
    return f"printf('%.{places}f', round_even({x}, {places}))"


def score_oracles() -> dict[str, str]:
    out = {}
    out["applicant_features"] = round_sql(with_roles("score_requests") + _features_select(), list(K.ALL_FEATURES))
    out["score_from_prob"] = round_sql(_scored_ctes() + "SELECT * FROM scored", ["p", "default_probability_pct"])
    ratio = f"({LA} / greatest({AI}, 1))"
    enq = n("enquiries")
    tips = ", ".join([
        f"CASE WHEN {ratio} > 3 THEN 'Reduce loan amount — ratio is ' || {_fmt(ratio, 1)} || 'x (target <3x)' END",
        f"CASE WHEN {U} > 0.3 THEN 'Lower CC utilization — ' || {_fmt(f'{U} * 100', 0)} || '% (target <30%)' END",
        f"CASE WHEN {LR} > 0.05 THEN 'Improve payment punctuality — ' || {_fmt(f'{LR} * 100', 1)} || '% late (target <5%)' END",
        f"CASE WHEN NOT {b('has_savings')} THEN 'Open a savings account — strong positive signal' END",
        f"CASE WHEN {enq} > 5 THEN 'Reduce credit enquiries — ' || CAST(CAST({enq} AS BIGINT) AS VARCHAR) || ' detected (target <5)' END",
    ])
    ai1 = f"greatest({AI}, 1)"
    km = {
        "km_credit_to_income": f"round_even({LA} / {ai1}, 2)",
        "km_payment_burden_pct": f"round_even({n('monthly_payment')} * 12 / {ai1} * 100, 1)",
        "km_cc_utilization_pct": f"round_even({U} * 100, 1)",
        "km_late_payment_pct": f"round_even({LR} * 100, 1)",
    }
    kms = ", ".join(f"{v} AS {k}" for k, v in km.items())
    oks = ", ".join([f"{km['km_credit_to_income']} < 3 AS ok_credit_to_income",
                     f"{km['km_payment_burden_pct']} < 35 AS ok_payment_burden",
                     f"{km['km_cc_utilization_pct']} < 30 AS ok_cc_utilization",
                     f"{km['km_late_payment_pct']} < 5 AS ok_late_payment"])
    out["tips_and_metrics"] = round_sql(
        with_roles("score_requests") +
        f"SELECT request_id, list_filter([{tips}], lambda t: t IS NOT NULL) AS improvement_tips, {kms}, {oks} FROM score_requests",
        list(km))
    out["batch_summary"] = round_sql(
        _scored_ctes() +
        "SELECT *, '=== SUMMARY: ' || CAST(n_scored AS VARCHAR) || '/' || CAST(n_total AS VARCHAR) || ' scored ===' AS summary_line, "
        f"CASE WHEN n_scored > 0 THEN 'Avg score: ' || {_fmt('mean_score', 0)} ELSE 'N/A' END AS summary_score, "
        f"CASE WHEN n_scored > 0 THEN 'Avg default prob: ' || {_fmt('mean_probability_pct', 1)} || '%' ELSE 'N/A' END AS summary_probability, "
        "'Approve:' || CAST(n_approve AS VARCHAR) || ' | Conditional:' || CAST(n_conditional AS VARCHAR) || "
        "' | Reject:' || CAST(n_reject AS VARCHAR) AS summary_recommendations FROM ("
        "SELECT count(*) FILTER (WHERE status = 'success') AS n_scored, count(*) AS n_total, "
        "avg(CASE WHEN status = 'success' THEN credit_score END) AS mean_score, "
        "avg(CASE WHEN status = 'success' THEN default_probability_pct END) AS mean_probability_pct, "
        "count(*) FILTER (WHERE status = 'success' AND recommendation = 'Approve') AS n_approve, "
        "count(*) FILTER (WHERE status = 'success' AND recommendation = 'Conditional') AS n_conditional, "
        "count(*) FILTER (WHERE status = 'success' AND recommendation = 'Reject') AS n_reject FROM scored) g",
        ["mean_score", "mean_probability_pct"])
    # evaluation on (TARGET, p) of every applicant
    ev = _scored_ctes().rstrip("\n") + ",\n" + (
        "lab AS (SELECT s.p, CAST(c.c_acctbal < 0 AS INTEGER) AS TARGET FROM scored s "
        "JOIN customer c ON c.c_custkey = s.request_id),\n"
        "sc2 AS (SELECT p AS score, count(*) FILTER (WHERE TARGET = 1) AS pos, count(*) FILTER (WHERE TARGET = 0) AS neg "
        "FROM lab WHERE p IS NOT NULL AND TARGET IS NOT NULL GROUP BY p),\n"
        "cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score) AS cum_pos, sum(neg) OVER (ORDER BY score) AS cum_neg, "
        "sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc2),\n"
        "roc AS (SELECT score AS threshold, (P - (cum_pos - pos)) / P AS tpr, (N - (cum_neg - neg)) / N AS fpr, "
        "pos, neg, cum_neg FROM cum)\n")
    out["roc_auc"] = round_sql(
        ev + "SELECT u / (np * nn) AS auc, 2 * (u / (np * nn)) - 1 AS gini, np AS n_positive, nn AS n_negative FROM "
             "(SELECT sum(pos * ((cum_neg - neg) + 0.5 * neg)) AS u, CAST(sum(pos) AS BIGINT) AS np, "
             "CAST(sum(neg) AS BIGINT) AS nn FROM roc) a", ["auc", "gini"])
    out["roc_curve"] = round_sql(ev + "SELECT threshold, tpr, fpr FROM roc UNION ALL SELECT NULL, 0.0, 0.0", ["threshold", "tpr", "fpr"])
    out["ks_stat"] = round_sql(ev + "SELECT greatest(max(tpr - fpr), 0) AS ks FROM roc", ["ks"])
    conf = ("conf AS (SELECT TARGET AS actual, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM lab "
            "WHERE TARGET IS NOT NULL AND p IS NOT NULL GROUP BY ALL)\n")
    out["confusion"] = ev.rstrip("\n") + ",\n" + conf + "SELECT * FROM conf"
    m = ("m AS (SELECT " + ", ".join(
        f"CAST(coalesce(sum(n) FILTER (WHERE actual = {a} AND predicted = {p}), 0) AS DOUBLE) AS n{a}{p}"
        for a in (0, 1) for p in (0, 1)) + " FROM conf),\n")
    per = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = f"n{k}{k}", f"n{o}{k}", f"n{k}{o}"
        prec = f"coalesce({_sdiv(tp, f'{tp} + {fp}')}, 0)"
        rec = f"coalesce({_sdiv(tp, f'{tp} + {fn}')}, 0)"
        per.append((prec, rec, f"coalesce({_sdiv(f'2 * {prec} * {rec}', f'{prec} + {rec}')}, 0)", f"{tp} + {fn}"))
    tot = "(n00 + n01 + n10 + n11)"
    rows = [f"SELECT '{k}' AS label, {p} AS precision, {r} AS recall, {f} AS f1, {s} AS support FROM m"
            for k, (p, r, f, s) in zip(("0", "1"), per)]
    rows.append(f"SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), coalesce({_sdiv('n00 + n11', tot)}, 0), {tot} FROM m")
    rows.append("SELECT 'macro avg', " + ", ".join(f"({per[0][i]} + {per[1][i]}) / 2" for i in range(3)) + f", {tot} FROM m")
    rows.append("SELECT 'weighted avg', " + ", ".join(
        f"coalesce({_sdiv(f'{per[0][i]} * ({per[0][3]}) + {per[1][i]} * ({per[1][3]})', tot)}, 0)" for i in range(3))
        + f", {tot} FROM m")
    out["class_report"] = round_sql(ev.rstrip("\n") + ",\n" + conf.rstrip("\n") + ",\n" + m + "\nUNION ALL\n".join(rows),
                                    ["precision", "recall", "f1", "support"])
    return out
