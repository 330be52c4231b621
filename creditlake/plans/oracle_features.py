"""Oracle SQL (DuckDB) for the rollups, source builders and unified table."""

from __future__ import annotations

from ..functions import catalog as K
from .roles_sql import with_roles

ROLLUP_SQL = {
    "bb": """SELECT SK_ID_BUREAU,
  count(*) FILTER (WHERE STATUS IN ('2', '3', '4', '5')) AS bad_months,
  count(*) FILTER (WHERE STATUS = 'X') AS dpd_months
FROM bureau_balance GROUP BY SK_ID_BUREAU""",
    "bur": """SELECT b.SK_ID_CURR,
  CAST(max(b.CREDIT_DAY_OVERDUE) AS DOUBLE) AS bureau_credit_day_overdue_max,
  coalesce(sum(b.AMT_CREDIT_SUM_OVERDUE), 0) AS bureau_credit_sum_overdue,
  coalesce(sum(b.AMT_CREDIT_SUM_DEBT), 0) / (coalesce(sum(b.AMT_CREDIT_SUM), 0) + 1) AS bureau_debt_to_credit_ratio,
  CAST(coalesce(sum(bb.bad_months), 0) AS DOUBLE) AS bureau_bad_status_months,
  avg(bb.dpd_months) AS bureau_dpd_months_mean,
  count(*) FILTER (WHERE b.CREDIT_ACTIVE = 'Active') / (count(b.CREDIT_ACTIVE) + 1) AS bureau_active_credit_ratio
FROM bureau b LEFT JOIN bb ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU GROUP BY b.SK_ID_CURR""",
    "inst_rows": """SELECT SK_ID_CURR, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS days_late,
  AMT_PAYMENT / (AMT_INSTALMENT + 1) AS pay_ratio
FROM installments""",
    "inst": """SELECT SK_ID_CURR,
  count(*) FILTER (WHERE days_late > 0) / (count(*) + 1) AS inst_late_payment_rate,
  count(*) FILTER (WHERE days_late < 0) / (count(*) + 1) AS inst_early_payment_rate,
  count(*) FILTER (WHERE days_late = 0) / (count(*) + 1) AS inst_on_time_rate,
  1 / (stddev_samp(pay_ratio) + 0.01) AS inst_payment_consistency,
  max(days_late) AS inst_days_late_max,
  avg(days_late) AS inst_days_late_mean,
  avg(pay_ratio) AS inst_payment_ratio_mean,
  stddev_samp(pay_ratio) AS inst_payment_ratio_std
FROM inst_rows GROUP BY SK_ID_CURR""",
    "pos": """SELECT SK_ID_CURR,
  count(*) FILTER (WHERE SK_DPD > 0) / (count(*) + 1) AS pos_dpd_rate,
  CAST(count(*) FILTER (WHERE SK_DPD > 0) AS DOUBLE) AS pos_dpd_occurrences,
  CAST(max(SK_DPD) AS DOUBLE) AS pos_sk_dpd_max,
  1 - avg(CNT_INSTALMENT_FUTURE) / (avg(CNT_INSTALMENT) + 1) AS pos_completion_ratio
FROM pos_cash GROUP BY SK_ID_CURR""",
    "card": """SELECT SK_ID_CURR,
  avg(AMT_BALANCE / (AMT_CREDIT_LIMIT_ACTUAL + 1)) AS cc_utilization_mean,
  max(AMT_BALANCE / (AMT_CREDIT_LIMIT_ACTUAL + 1)) AS cc_utilization_max,
  avg(AMT_PAYMENT_CURRENT / (AMT_INST_MIN_REGULARITY + 1)) AS cc_payment_rate_mean,
  stddev_samp(AMT_PAYMENT_CURRENT / (AMT_INST_MIN_REGULARITY + 1)) AS cc_payment_rate_std,
  avg(SK_DPD) AS cc_dpd_mean,
  CAST(max(SK_DPD) AS DOUBLE) AS cc_dpd_max,
  avg(AMT_DRAWINGS_CURRENT / (AMT_CREDIT_LIMIT_ACTUAL + 1)) AS cc_drawing_rate_mean,
  avg(AMT_DRAWINGS_ATM_CURRENT / (AMT_DRAWINGS_CURRENT + 1)) AS cc_atm_to_total_drawing
FROM card_balance GROUP BY SK_ID_CURR""",
    "prev": """SELECT SK_ID_CURR,
  count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Approved') / (count(SK_ID_PREV) + 1) AS prev_approval_rate,
  count(*) FILTER (WHERE NAME_CONTRACT_STATUS = 'Refused') / (count(SK_ID_PREV) + 1) AS prev_refusal_rate,
  CAST(count(SK_ID_PREV) AS DOUBLE) AS prev_total_applications
FROM previous_application GROUP BY SK_ID_CURR""",
    "txn": """SELECT account_id,
  count(trans_id) AS trans_count, avg(balance) AS mean_balance, min(balance) AS min_balance,
  stddev_samp(balance) AS std_balance,
  count(*) FILTER (WHERE balance < 0) AS neg_bal_count,
  coalesce(sum(amount), 0) AS total_credit,
  1 / (stddev_samp(balance) + 1) AS balance_consistency,
  count(*) FILTER (WHERE balance < 0) / (count(trans_id) + 1) AS neg_balance_rate
FROM bank_transactions GROUP BY account_id""",
}

ROLLUP_DEPS = {
    "bb": ["bureau_balance"], "bur": ["bureau", "bureau_balance"],
    "inst_rows": ["installments"], "inst": ["installments"], "pos": ["pos_cash"],
    "card": ["card_balance"], "prev": ["previous_application"], "txn": ["bank_transactions"],
}
ROLLUP_NEEDS = {"bur": ["bb"], "inst": ["inst_rows"]}


def with_rollups(*names, roles=(), extra=None):
    need, roles_needed = [], list(roles)
    for n in names:
        for d in ROLLUP_NEEDS.get(n, []) + [n]:
            if d not in need:
                need.append(d)
    for n in need:
        roles_needed += ROLLUP_DEPS[n]
    return with_roles(*roles_needed, extra=[(n, ROLLUP_SQL[n]) for n in need] + list(extra or []))


def round_sql(sql: str, doubles: list[str], places: int = 6) -> str:
    if not doubles:
        return sql
    sc = f"CAST({10 ** places} AS DOUBLE)"
    rep = ", ".join(f"round(CAST({d} AS DOUBLE) * {sc}) / {sc} + CAST(0 AS DOUBLE) AS {d}" for d in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) q"


def _rollup_query(rollup, features):
    cols = ", ".join(f"r.{f}" for f in features)
    sql = (with_rollups(rollup) +
           f"SELECT c.c_custkey AS SK_ID_CURR, {cols} FROM customer c "
           f"LEFT JOIN {rollup} r ON r.SK_ID_CURR = c.c_custkey")
    return round_sql(sql, features)


def rollup_oracles() -> dict[str, str]:
    from ..operators import rollups as R
    out = {
        "bureau_status_counts": with_rollups("bb", roles=["bureau"]) +
        "SELECT b.SK_ID_BUREAU, b.SK_ID_CURR, bb.bad_months, bb.dpd_months "
        "FROM bureau b LEFT JOIN bb ON b.SK_ID_BUREAU = bb.SK_ID_BUREAU",
        "bureau_rollup": _rollup_query("bur", R.BUREAU_FEATURES),
        "installment_rollup": _rollup_query("inst", R.INSTALLMENT_FEATURES),
        "pos_rollup": _rollup_query("pos", R.POS_FEATURES),
        "card_rollup": _rollup_query("card", R.CARD_FEATURES),
        "prev_rollup": _rollup_query("prev", R.PREV_FEATURES),
    }
    txn_d = ["mean_balance", "min_balance", "std_balance", "total_credit",
             "balance_consistency", "neg_balance_rate"]
    out["txn_rollup"] = round_sql(
        with_rollups("txn", roles=["bank_loans"]) +
        "SELECT l.loan_id, l.account_id, t.trans_count, t.mean_balance, t.min_balance, t.std_balance, "
        "t.neg_bal_count, t.total_credit, t.balance_consistency, t.neg_balance_rate "
        "FROM bank_loans l LEFT JOIN txn t ON t.account_id = l.account_id", txn_d)
    return out


# --------------------------------------------------------------- builders
def _select_catalogue(exprs: dict[str, str], sid: str, target: str, source: str) -> str:
    cols = [f"CAST({sid} AS VARCHAR) || '{K.ID_SUFFIX[source]}' AS source_id",
            f"CAST({target} AS INTEGER) AS TARGET", f"'{source}' AS source_dataset"]
    for f in K.ALL_FEATURES:
        e = exprs.get(f)
        cols.append(f"CAST({e} AS DOUBLE) AS {f}" if e else f"CAST(NULL AS DOUBLE) AS {f}")
    return "SELECT " + ",\n  ".join(cols)


def _flag(pred):
    return f"CAST(coalesce({pred}, false) AS INTEGER)"


def _clip(x, lo, hi):
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} < {lo} THEN {lo} WHEN {x} > {hi} THEN {hi} ELSE {x} END)"


HC_EXPRS = {
    "income_total": "AMT_INCOME_TOTAL", "credit_amount": "AMT_CREDIT", "annuity_amount": "AMT_ANNUITY",
    "credit_to_income": "AMT_CREDIT / (AMT_INCOME_TOTAL + 1)",
    "annuity_to_income": "AMT_ANNUITY / (AMT_INCOME_TOTAL + 1)",
    "credit_to_goods": "AMT_CREDIT / (AMT_GOODS_PRICE + 1)",
    "loan_amount_to_goods": "AMT_CREDIT / (AMT_GOODS_PRICE + 1)",
    "income_per_person": "AMT_INCOME_TOTAL / (CNT_FAM_MEMBERS + 1)",
    "credit_per_month": "AMT_CREDIT / " + _clip("(AMT_CREDIT / (AMT_ANNUITY + 1))", 1, 360),
    "ext_source_1": "EXT_SOURCE_1", "ext_source_2": "EXT_SOURCE_2", "ext_source_3": "EXT_SOURCE_3",
    "ext_source_mean": "list_avg([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "ext_source_std": "list_stddev_samp([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "ext_source_min": "list_min([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "ext_source_count": "list_count([EXT_SOURCE_1, EXT_SOURCE_2, EXT_SOURCE_3])",
    "docs_submission_rate": "(coalesce(FLAG_DOCUMENT_2, 0) + coalesce(FLAG_DOCUMENT_3, 0) + coalesce(FLAG_DOCUMENT_4, 0)) / 3",
    "total_enquiries": "coalesce(AMT_REQ_CREDIT_BUREAU_MON, 0) + coalesce(AMT_REQ_CREDIT_BUREAU_YEAR, 0)",
    "recent_enquiries_1yr": "AMT_REQ_CREDIT_BUREAU_YEAR",
    "age_years": "round_even(-DAYS_BIRTH / 365, 1)",
    "employment_years": "round_even(-(CASE WHEN DAYS_EMPLOYED IS NULL THEN NULL WHEN DAYS_EMPLOYED < 0 THEN DAYS_EMPLOYED ELSE 0 END) / 365, 1)",
    "employed_flag": _flag("DAYS_EMPLOYED < 0"), "is_employed": _flag("DAYS_EMPLOYED < 0"),
    "own_car_flag": _flag("FLAG_OWN_CAR = 'Y'"), "own_realty_flag": _flag("FLAG_OWN_REALTY = 'Y'"),
    "family_members": "CNT_FAM_MEMBERS", "children_count": "CNT_CHILDREN",
    "region_rating": "REGION_RATING_CLIENT",
    "live_work_same_region": _flag("REG_CITY_NOT_LIVE_CITY = 0"),
    "has_telephone": "FLAG_MOBIL",
    "name_contract_type": "codes.code",
    "has_loan_history": _flag("prev.prev_total_applications IS NOT NULL"),
}


def hc_sql() -> str:
    from ..operators import rollups as R
    for f in R.BUREAU_FEATURES:
        HC_EXPRS.setdefault(f, f"bur.{f}")
    for f in R.INSTALLMENT_FEATURES:
        HC_EXPRS.setdefault(f, f"inst.{f}")
    for f in R.POS_FEATURES:
        HC_EXPRS.setdefault(f, f"pos.{f}")
    for f in R.CARD_FEATURES:
        HC_EXPRS.setdefault(f, f"card.{f}")
    for f in R.PREV_FEATURES:
        HC_EXPRS.setdefault(f, f"prev.{f}")
    codes = ("SELECT k, dense_rank() OVER (ORDER BY k) - 1 AS code FROM "
             "(SELECT DISTINCT coalesce(NAME_CONTRACT_TYPE, 'nan') AS k FROM applicants) d")
    w = with_rollups("bur", "inst", "pos", "card", "prev", roles=["applicants"],
                     extra=[("codes", codes)])
    return (w + _select_catalogue(HC_EXPRS, "a.SK_ID_CURR", "a.TARGET", K.SOURCE_HC) +
            "\nFROM applicants a LEFT JOIN codes ON codes.k = coalesce(a.NAME_CONTRACT_TYPE, 'nan')"
            " LEFT JOIN bur ON bur.SK_ID_CURR = a.SK_ID_CURR"
            " LEFT JOIN inst ON inst.SK_ID_CURR = a.SK_ID_CURR"
            " LEFT JOIN pos ON pos.SK_ID_CURR = a.SK_ID_CURR"
            " LEFT JOIN card ON card.SK_ID_CURR = a.SK_ID_CURR"
            " LEFT JOIN prev ON prev.SK_ID_CURR = a.SK_ID_CURR")


_TL = "(late_30_59 + late_60_89 + late_90plus)"
_LR = _clip(f"({_TL} / 37)", 0, 1)
GM_EXPRS = {
    "age_years": "age_years", "income_total": "monthly_income * 12",
    "family_members": "dependents + 1", "children_count": "dependents",
    "income_per_person": "(monthly_income * 12) / (dependents + 2)",
    "debt_ratio": "debt_ratio", "credit_to_income": "debt_ratio",
    "cc_utilization_mean": _clip("revolving_util", 0, 5),
    "existing_credits_count": "open_credits",
    "own_realty_flag": _flag("real_estate_loans > 0"),
    "bureau_active_credit_ratio": "open_credits / (open_credits + 1)",
    "inst_late_payment_rate": _LR, "inst_on_time_rate": f"1 - {_LR}",
    "has_past_delays": _flag(f"{_TL} > 0"),
    "inst_days_late_max": "CASE WHEN late_90plus > 0 THEN 90 WHEN late_60_89 > 0 THEN 60 WHEN late_30_59 > 0 THEN 30 ELSE 0 END",
    "credit_history_ordinal": "CASE WHEN late_90plus > 0 THEN 0 WHEN late_60_89 > 0 THEN 1 WHEN late_30_59 > 0 THEN 2 ELSE 4 END",
    "has_critical_account": _flag("late_90plus > 2"),
    "has_loan_history": _flag("open_credits > 0"),
}


def gm_sql() -> str:
    return with_roles("survey") + _select_catalogue(GM_EXPRS, "row_id", "TARGET", K.SOURCE_GM) + "\nFROM survey"


_LLR = _clip("(delinq_2yrs / 25)", 0, 1)
_EMP = ("CASE emp_length " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.LC_EMP_LENGTH_MAP.items())
        + " ELSE 0 END")
LC_EXPRS = {
    "income_total": "annual_inc", "credit_amount": "loan_amnt", "annuity_amount": "installment",
    "credit_to_income": "loan_amnt / (annual_inc + 1)", "installment_rate_pct": "dti",
    "debt_ratio": "dti / 100",
    "credit_per_month": "loan_amnt / (TRY_CAST(nullif(regexp_extract(term, '(\\d+)', 1), '') AS DOUBLE) + 1)",
    "annuity_to_income": "(installment * 12) / (annual_inc + 1)",
    "has_past_delays": _flag("delinq_2yrs > 0"),
    "inst_late_payment_rate": _LLR, "inst_on_time_rate": f"1 - {_LLR}",
    "inst_days_late_max": "CASE WHEN num_accts_ever_120_pd > 0 THEN 120 WHEN delinq_2yrs > 0 THEN 30 ELSE 0 END",
    "credit_history_ordinal": "CASE WHEN num_accts_ever_120_pd > 0 THEN 0 WHEN delinq_2yrs > 0 THEN 2 ELSE 4 END",
    "has_critical_account": _flag("num_accts_ever_120_pd > 0"),
    "prev_approval_rate": "pct_tl_nvr_dlq / 100",
    "cc_utilization_mean": "TRY_CAST(replace(CAST(revol_util AS VARCHAR), '%', '') AS DOUBLE) / 100",
    "existing_credits_count": "open_acc",
    "bureau_active_credit_ratio": "open_acc / (total_acc + 1)",
    "bureau_debt_to_credit_ratio": "revol_bal / (tot_cur_bal + 1)",
    "total_enquiries": "pub_rec",
    "own_realty_flag": _flag("home_ownership IN ('MORTGAGE', 'OWN')"),
    "owns_house": _flag("home_ownership = 'OWN'"),
    "employment_stability": _EMP,
    "employed_flag": _flag("emp_length IS NOT NULL AND emp_length <> 'n/a'"),
    "is_employed": _flag("emp_length IS NOT NULL AND emp_length <> 'n/a'"),
    "senior_employee": _flag(f"({_EMP}) >= 4"),
    "loan_purpose_high_risk": _flag("purpose IN (" + ", ".join(f"'{p}'" for p in K.LC_HIGH_RISK_PURPOSE) + ")"),
    "loan_purpose_encoded": "codes.code",
    "has_loan_history": "1",
}


def lc_sql() -> str:
    active = ", ".join(f"'{s}'" for s in K.LC_ACTIVE_STATUS)
    defaults = ", ".join(f"'{s}'" for s in K.LC_DEFAULT_STATUS)
    kept = (f"SELECT *, CAST(coalesce(loan_status IN ({defaults}), false) AS INTEGER) AS TARGET "
            f"FROM lending WHERE loan_status NOT IN ({active})")
    codes = ("SELECT k, dense_rank() OVER (ORDER BY k) - 1 AS code FROM "
             "(SELECT DISTINCT coalesce(purpose, 'nan') AS k FROM lc_kept) d")
    w = with_roles("lending", extra=[("lc_kept", kept), ("codes", codes)])
    return (w + _select_catalogue(LC_EXPRS, "id", "TARGET", K.SOURCE_LC) +
            "\nFROM lc_kept LEFT JOIN codes ON codes.k = coalesce(lc_kept.purpose, 'nan')")


_CHK = ("CASE WHEN mean_balance <= 0 THEN 1 WHEN mean_balance <= 200 THEN 2 "
        "WHEN mean_balance <= 1000 THEN 3 WHEN mean_balance > 1000 THEN 4 END")
_SAV = f"({_flag('mean_balance > 200')} + {_flag('mean_balance > 500')} + {_flag('mean_balance > 1000')})"
CZ_EXPRS = {
    "credit_amount": "amount", "credit_per_month": "amount / (duration + 1)",
    "annuity_amount": "payments", "income_total": "total_credit",
    "credit_to_income": "amount / (total_credit + 1)",
    "annuity_to_income": "payments / (total_credit / 12 + 1)",
    "checking_account_ordinal": _CHK, "has_checking_account": "1",
    "has_savings": _flag("mean_balance > 500"), "savings_above_500": _flag("mean_balance > 500"),
    "savings_account_ordinal": _SAV,
    "inst_payment_consistency": "balance_consistency",
    "inst_late_payment_rate": "neg_balance_rate", "inst_on_time_rate": "1 - neg_balance_rate",
    "has_past_delays": _flag("min_balance < 0"),
    "inst_days_late_max": "CASE WHEN min_balance < -500 THEN 60 WHEN min_balance < 0 THEN 30 ELSE 0 END",
    "credit_history_ordinal": f"CASE WHEN {_flag('min_balance < 0')} = 1 THEN 2 ELSE 4 END",
    "has_critical_account": _flag("min_balance < -1000"),
    "stability_score": f"coalesce({_CHK}, 0) + {_SAV} + {_flag('mean_balance > 500')}",
    "has_loan_history": "1",
}


def cz_sql() -> str:
    w = with_rollups("txn", roles=["bank_loans"])
    return (w + _select_catalogue(CZ_EXPRS, "l.loan_id",
                                  "CAST(coalesce(l.status IN ('B', 'D'), false) AS INTEGER)", K.SOURCE_CZ) +
            "\nFROM bank_loans l LEFT JOIN txn ON txn.account_id = l.account_id")


def unified_sql() -> str:
    """The unified table as a subquery-able SELECT (each source in parens)."""
    parts = [hc_sql(), gm_sql(), lc_sql(), cz_sql()]
    return "\nUNION ALL BY NAME\n".join(f"SELECT * FROM ({p})" for p in parts)


def feature_oracles() -> dict[str, str]:
    feats = list(K.ALL_FEATURES)
    return {
        "hc_features": round_sql(hc_sql(), feats),
        "gm_features": round_sql(gm_sql(), feats),
        "lc_features": round_sql(lc_sql(), feats),
        "cz_features": round_sql(cz_sql(), feats),
        "unify_sources": round_sql(unified_sql(), feats),
    }
