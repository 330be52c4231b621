"""Scoring operators.

Scoring a batch is one projection over the request DataFrame (the per-row
Python loop of a web handler becomes column expressions), plus one global
aggregate for the batch summary. Works unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions import catalog as K
from ..functions.expr import bround, div, flag, null_d

D = K.REQUEST_DEFAULTS


def _num(df: DataFrame, name: str) -> Column:
    """P25: numeric field with default; text that is no number -> default."""
    d = float(D[name])
    if name not in df.columns:
        return F.lit(d)
    t = df.schema[name].dataType
    x = F.col(name).cast("double") if isinstance(t, NumericType) else F.expr(f"try_cast(trim(`{name}`) as double)")
    return F.coalesce(x, F.lit(d))


def _bool(df: DataFrame, name: str) -> Column:
    """P25: boolean field; text accepted as true: 'true', '1', 'yes' (and the
    float rendering '1.0'); missing -> default."""
    d = bool(D[name])
    if name not in df.columns:
        return F.lit(d)
    t = df.schema[name].dataType
    if isinstance(t, BooleanType):
        return F.coalesce(F.col(name), F.lit(d))
    v = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(F.col(name).isNull(), F.lit(d)).otherwise(v.isin("true", "1", "yes", "1.0"))


def request_validity(df: DataFrame) -> Column:
    """A row fails when income or loan amount is present but not a number."""
    bad = F.lit(False)
    for name in ("annual_income", "loan_amount"):
        if name in df.columns and not isinstance(df.schema[name].dataType, NumericType):
            raw = F.trim(F.col(name).cast("string"))
            bad = bad | (raw.isNotNull() & (raw != "") & F.expr(f"try_cast(trim(`{name}`) as double)").isNull())
    return F.when(bad, F.lit("error: could not convert income or loan amount to float")).otherwise(F.lit("success"))


def applicant_features(df: DataFrame) -> dict[str, Column]:
    """P24 + P26: the 84 catalogue features from request fields."""
    ai, la = _num(df, "annual_income"), _num(df, "loan_amount")
    mp, term, dti = _num(df, "monthly_payment"), _num(df, "loan_term"), _num(df, "dti")
    fam = _num(df, "family_size")
    chk, sav = _num(df, "checking_tier"), _num(df, "savings_tier")
    stab, ey = _num(df, "employment_stability"), _num(df, "employment_years")
    lr, ml = _num(df, "late_payment_rate"), _num(df, "max_days_late")
    u, ar = _num(df, "cc_utilization"), _num(df, "approval_rate")
    ec, enq = _num(df, "existing_credits"), _num(df, "enquiries")
    new = _bool(df, "is_new_user")
    owns = flag(_bool(df, "owns_property"))
    employed = flag(_bool(df, "employed", ))
    risk = flag(_bool(df, "high_risk_purpose"))
    ltg = div(la, la * 1.05 + 1)
    f = {
        "income_total": ai, "credit_amount": la, "annuity_amount": mp,
        "credit_to_income": div(la, ai + 1), "annuity_to_income": div(mp * 12, ai + 1),
        "income_per_person": div(ai, fam + 1), "credit_per_month": div(la, term + 1),
        "installment_rate_pct": dti, "debt_ratio": dti / 100,
        "loan_amount_to_goods": ltg, "credit_to_goods": ltg,
        "has_savings": flag(_bool(df, "has_savings")),
        "savings_above_500": flag(_num(df, "savings_amount") > 500),
        "has_checking_account": flag(_bool(df, "has_checking")),
        "checking_account_ordinal": chk, "savings_account_ordinal": sav,
        "docs_submission_rate": _num(df, "docs_rate"),
        "ext_source_count": F.when(new, F.lit(0.0)).otherwise(F.lit(2.0)),
        "ext_source_mean": F.when(new, null_d()).otherwise(F.lit(0.55)),
        "stability_score": chk + sav + stab + owns,
        "inst_late_payment_rate": lr, "inst_on_time_rate": 1 - lr,
        "inst_payment_consistency": div(F.lit(1.0), lr + 0.01),
        "inst_days_late_max": ml, "inst_payment_ratio_mean": 1 - lr * 0.3,
        "inst_payment_ratio_std": lr * 0.2,
        "inst_early_payment_rate": F.greatest(F.lit(0.0), 0.1 - lr),
        "inst_days_late_mean": ml * 0.4,
        "pos_dpd_rate": lr * 0.5, "pos_dpd_occurrences": lr * 24, "pos_sk_dpd_max": ml,
        "pos_completion_ratio": 1 - lr * 0.3,
        "cc_payment_rate_mean": 1 - lr * 0.5, "cc_payment_rate_std": lr * 0.1,
        "cc_dpd_mean": ml * 0.2, "cc_dpd_max": ml,
        "cc_utilization_mean": u, "cc_utilization_max": F.least(u * 1.3, F.lit(1.0)),
        "cc_drawing_rate_mean": u * 0.8, "cc_atm_to_total_drawing": F.lit(0.2),
        "credit_history_ordinal": _num(df, "credit_history"),
        "has_past_delays": flag(_bool(df, "has_past_delays")),
        "has_critical_account": flag(ml > 60),
        "has_loan_history": F.when(new, F.lit(0)).otherwise(F.lit(1)),
        "prev_approval_rate": ar, "prev_refusal_rate": 1 - ar,
        "prev_total_applications": _num(df, "prev_applications"),
        "bureau_debt_to_credit_ratio": dti / 100,
        "bureau_credit_day_overdue_max": ml,
        "bureau_bad_status_months": (lr * 24).cast("int").cast("double"),
        "bureau_credit_sum_overdue": la * lr * 0.1,
        "bureau_dpd_months_mean": lr * 3,
        "bureau_active_credit_ratio": F.least(ec / 10, F.lit(1.0)),
        "age_years": _num(df, "age"), "employment_years": ey,
        "employed_flag": employed, "is_employed": employed,
        "employment_stability": stab, "senior_employee": flag(ey >= 4),
        "own_realty_flag": owns, "owns_house": owns, "owns_property": owns,
        "own_car_flag": F.lit(0), "family_members": fam,
        "children_count": F.greatest(F.lit(0.0), fam - 1),
        "has_telephone": F.lit(1), "region_rating": _num(df, "region_rating"),
        "live_work_same_region": F.lit(1), "existing_credits_count": ec,
        "total_enquiries": enq, "recent_enquiries_1yr": enq,
        "loan_purpose_high_risk": risk, "loan_purpose_encoded": risk,
        "has_guarantor": flag(_bool(df, "has_guarantor")),
        "has_co_applicant": F.lit(0), "has_other_installments": flag(ec > 0),
        "other_install_bank": F.lit(0), "name_contract_type": F.lit(0),
    }
    return {k: v.cast("double") for k, v in f.items()}


def build_applicant_features(df: DataFrame, keep=("request_id",)) -> DataFrame:
    feats = applicant_features(df)
    cols = [F.col(k) for k in keep if k in df.columns]
    cols += [feats.get(f, null_d()).alias(f) for f in K.ALL_FEATURES]
    return df.select(*cols)


# ------------------------------------------------------------ P27-P29
def prob_to_score(p, lo: int = K.SCORE_MIN, hi: int = K.SCORE_MAX) -> Column:
    """Probability of default -> score; log-odds of repayment clipped
    to +-4, mapped linearly to [lo, hi], rounded half to even."""
    pc = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    od = F.least(F.greatest(F.log((1 - pc) / pc), F.lit(-4.0)), F.lit(4.0))
    return F.when(p.isNull(), F.lit(None)).otherwise(bround(lo + (od + 4) / 8 * (hi - lo), 0).cast("int"))


def band(score: Column) -> Column:
    """P28."""
    e = None
    for t, name in K.BANDS:
        e = F.when(score >= t, name) if e is None else e.when(score >= t, name)
    return F.when(score.isNull(), F.lit(None)).otherwise(e.otherwise(K.BAND_FLOOR))


def recommendation(score: Column) -> Column:
    """P29."""
    e = None
    for t, name in K.RECOMMENDATIONS:
        e = F.when(score >= t, name) if e is None else e.when(score >= t, name)
    return e.otherwise(K.RECOMMENDATION_FLOOR)


# ------------------------------------------------------------ P30-P32
def _fmt(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", bround(x, places))


def improvement_tips(df: DataFrame) -> Column:
    """Up to five advice strings (fixed texts), in a fixed order."""
    ai, la = _num(df, "annual_income"), _num(df, "loan_amount")
    ratio = la / F.greatest(ai, F.lit(1.0))
    u, lr, enq = _num(df, "cc_utilization"), _num(df, "late_payment_rate"), _num(df, "enquiries")
    # fixed texts
    tips = [
        F.when(ratio > 3, F.concat(F.lit("Reduce loan amount — ratio is "), _fmt(ratio, 1), F.lit("x (target <3x)"))),
        F.when(u > 0.3, F.concat(F.lit("Lower CC utilization — "), _fmt(u * 100, 0), F.lit("% (target <30%)"))),
        F.when(lr > 0.05, F.concat(F.lit("Improve payment punctuality — "), _fmt(lr * 100, 1),
                                   F.lit("% late (target <5%)"))),
        F.when(~_bool(df, "has_savings"), F.lit("Open a savings account — strong positive signal")),
        F.when(enq > 5, F.concat(F.lit("Reduce credit enquiries — "), enq.cast("long").cast("string"),
                                 F.lit(" detected (target <5)"))),
    ]
    return F.filter(F.array(*tips), lambda t: t.isNotNull())


def key_metrics(df: DataFrame) -> dict[str, Column]:
    """P31 + P32: headline ratios (income floored at 1) and health flags."""
    ai = F.greatest(_num(df, "annual_income"), F.lit(1.0))
    m = {
        "km_credit_to_income": bround(_num(df, "loan_amount") / ai, 2),
        "km_payment_burden_pct": bround(_num(df, "monthly_payment") * 12 / ai * 100, 1),
        "km_cc_utilization_pct": bround(_num(df, "cc_utilization") * 100, 1),
        "km_late_payment_pct": bround(_num(df, "late_payment_rate") * 100, 1),
    }
    m["ok_credit_to_income"] = m["km_credit_to_income"] < 3
    m["ok_payment_burden"] = m["km_payment_burden_pct"] < 35
    m["ok_cc_utilization"] = m["km_cc_utilization_pct"] < 30
    m["ok_late_payment"] = m["km_late_payment_pct"] < 5
    return m


# ---------------------------------------------------------- M13 / M15
def score_outputs(df: DataFrame, prob: Column, status: Column | None = None) -> DataFrame:
    """Append score, band, probability %, recommendation and status; failed
    rows get NULL outputs and recommendation 'Error' (never raises)."""
    status = status if status is not None else request_validity(df)
    ok = status == "success"
    s = F.when(ok, prob_to_score(prob))
    return df.withColumn("status", status).select(
        "*",
        s.alias("credit_score"),
        F.when(ok, band(s)).alias("score_band"),
        F.when(ok, bround(prob * 100, 2)).alias("default_probability_pct"),
        F.when(ok, recommendation(s)).otherwise(F.lit("Error")).alias("recommendation"),
    )


# Stand-in linear scorer for operators that only need a probability column
# (fixed coefficients; the trained models live in operators.model).
LINEAR_SCORER = {"intercept": -1.5, "inst_late_payment_rate": 4.0, "cc_utilization_mean": 1.5,
                 "credit_to_income": 0.1, "has_savings": -0.4, "stability_score": -0.05}


def linear_probability(feats: dict[str, Column]) -> Column:
    z = F.lit(LINEAR_SCORER["intercept"])
    for k, w in LINEAR_SCORER.items():
        if k != "intercept":
            z = z + F.lit(w) * F.coalesce(feats[k], F.lit(0.0))
    return 1 / (1 + F.exp(-z))


# ----------------------------------------------------------- A22 / U3
def batch_summary(scored: DataFrame) -> DataFrame:
    """Counts, means and recommendation mix over the successful rows,
    with the formatted summary line of the batch file (U3)."""
    ok = F.col("status") == "success"
    rec = F.col("recommendation")
    g = scored.agg(
        F.count_if(ok).alias("n_scored"), F.count(F.lit(1)).alias("n_total"),
        F.avg(F.when(ok, F.col("credit_score"))).alias("mean_score"),
        F.avg(F.when(ok, F.col("default_probability_pct"))).alias("mean_probability_pct"),
        F.count_if(ok & (rec == "Approve")).alias("n_approve"),
        F.count_if(ok & (rec == "Conditional")).alias("n_conditional"),
        F.count_if(ok & (rec == "Reject")).alias("n_reject"))
    has = F.col("n_scored") > 0
    return g.select(
        "*",
        F.concat(F.lit("=== SUMMARY: "), F.col("n_scored").cast("string"), F.lit("/"),
                 F.col("n_total").cast("string"), F.lit(" scored ===")).alias("summary_line"),
        F.when(has, F.concat(F.lit("Avg score: "), _fmt(F.col("mean_score"), 0))).otherwise("N/A").alias("summary_score"),
        F.when(has, F.concat(F.lit("Avg default prob: "), _fmt(F.col("mean_probability_pct"), 1), F.lit("%")))
         .otherwise("N/A").alias("summary_probability"),
        F.concat(F.lit("Approve:"), F.col("n_approve").cast("string"), F.lit(" | Conditional:"),
                 F.col("n_conditional").cast("string"), F.lit(" | Reject:"),
                 F.col("n_reject").cast("string")).alias("summary_recommendations"))


def append_summary_row(scored: DataFrame, summary: DataFrame) -> DataFrame:
    """The scored rows followed by one text summary row (all columns as
    strings, as in the downloadable batch file)."""
    cols = scored.columns
    body = scored.select(*[F.col(c).cast("string").alias(c) for c in cols])
    srow = summary.select(*[
        (F.col("summary_line") if c == "credit_score" else
         F.col("summary_score") if c == "score_band" else
         F.col("summary_probability") if c == "default_probability_pct" else
         F.col("summary_recommendations") if c == "recommendation" else F.lit("")).alias(c) for c in cols])
    return body.unionByName(srow)


# -------------------------------------------------------------- P33 / P35
# Input domains of the scoring form (fixed values): field -> (min, max) or
# the allowed set; fractions are on the 0-1 scale the scorer uses.
INPUT_RANGES = [
    ("annual_income", 0, None), ("loan_amount", 0, None), ("monthly_payment", 0, None),
    ("dti", 0, 80), ("savings_amount", 0, None), ("age", 18, 75), ("family_size", 1, 15),
    ("employment_years", 0, 40), ("cc_utilization", 0, 1), ("existing_credits", 0, 20),
    ("enquiries", 0, 20), ("docs_rate", 0, 1), ("late_payment_rate", 0, 0.5),
    ("approval_rate", 0, 1), ("prev_applications", 0, 20),
    ("checking_tier", 0, 4), ("savings_tier", 0, 4), ("employment_stability", 0, 4), ("region_rating", 1, 3),
]
INPUT_SETS = [("loan_term", [12, 24, 36, 48, 60]), ("max_days_late", [0, 30, 60, 90, 120]),
              ("credit_history", [0, 1, 2, 3, 4])]
PERCENT_FIELDS = ["cc_utilization", "late_payment_rate", "approval_rate", "docs_rate"]


def rule_name(field: str, lo, hi) -> str:
    return f"{field} outside [{'' if lo is None else lo}, {'' if hi is None else hi}]"


def input_rule_violations(df: DataFrame) -> Column:
    """Names of the form's input-domain rules a request breaks (after
    the same tolerant coercion as scoring), in a fixed order."""
    checks = []
    for f, lo, hi in INPUT_RANGES:
        x = _num(df, f)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (x < lo)
        if hi is not None:
            bad = bad | (x > hi)
        checks.append(F.when(bad, F.lit(rule_name(f, lo, hi))))
    for f, allowed in INPUT_SETS:
        checks.append(F.when(~_num(df, f).isin([float(a) for a in allowed]),
                             F.lit(f"{f} not in {{{', '.join(str(a) for a in allowed)}}}")))
    return F.filter(F.array(*checks), lambda t: t.isNotNull())


def percent_to_fraction(df: DataFrame, fields=PERCENT_FIELDS) -> DataFrame:
    """Form fields entered in percent -> fractions (opt-in)."""
    return df.withColumns({f: F.col(f).cast("double") / 100 for f in fields if f in df.columns})
