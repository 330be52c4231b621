"""Feature catalogue, request schema and other values that must match the
reference pipeline exactly.

Everything under the "FIXED VALUES" markers is data, not logic: feature
names and their order, group membership, request-field defaults, label
text, score thresholds. Order matters (feature selection, correlation
subsets and output column order all follow it).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — feature catalogue (group -> ordered feature names)
# ---------------------------------------------------------------------------
FEATURE_GROUPS: dict[str, list[str]] = {
    "income_loan": [
        "income_total", "credit_amount", "annuity_amount",
        "credit_to_income", "annuity_to_income", "credit_to_goods",
        "income_per_person", "credit_per_month", "installment_rate_pct",
        "loan_amount_to_goods",
    ],
    "alternative_signals": [
        "ext_source_1", "ext_source_2", "ext_source_3",
        "ext_source_mean", "ext_source_std", "ext_source_min", "ext_source_count",
        "checking_account_ordinal", "savings_account_ordinal",
        "has_savings", "savings_above_500", "stability_score",
        "docs_submission_rate", "has_checking_account",
    ],
    "payment_behaviour": [
        "inst_late_payment_rate", "inst_early_payment_rate", "inst_on_time_rate",
        "inst_payment_consistency", "inst_days_late_mean", "inst_days_late_max",
        "inst_payment_ratio_mean", "inst_payment_ratio_std",
        "pos_dpd_rate", "pos_dpd_occurrences", "pos_sk_dpd_max", "pos_completion_ratio",
        "cc_payment_rate_mean", "cc_payment_rate_std", "cc_dpd_mean", "cc_dpd_max",
    ],
    "credit_history": [
        "credit_history_ordinal", "has_past_delays", "has_critical_account",
        "bureau_debt_to_credit_ratio", "bureau_credit_day_overdue_max",
        "bureau_credit_sum_overdue", "bureau_bad_status_months",
        "bureau_dpd_months_mean", "bureau_active_credit_ratio",
        "prev_approval_rate", "prev_refusal_rate", "prev_total_applications",
        "has_loan_history",
    ],
    "stability_demographics": [
        "age_years", "employment_years", "employed_flag", "employment_stability",
        "is_employed", "senior_employee", "present_residence_since",
        "own_car_flag", "own_realty_flag", "owns_property", "owns_house",
        "has_telephone", "region_rating", "live_work_same_region",
        "family_members", "children_count",
    ],
    "credit_utilisation": [
        "cc_utilization_mean", "cc_utilization_max",
        "cc_atm_to_total_drawing", "cc_drawing_rate_mean",
        "existing_credits_count", "total_enquiries", "recent_enquiries_1yr",
        "debt_ratio",
    ],
    "loan_structure": [
        "name_contract_type", "loan_purpose_high_risk", "loan_purpose_encoded",
        "has_guarantor", "has_co_applicant", "has_other_installments",
        "other_install_bank",
    ],
}

# Source ids and suffixes (fixed values).
SOURCE_HC = "home_credit"
SOURCE_GM = "give_me_some_credit"
SOURCE_LC = "lending_club"
SOURCE_CZ = "pkdd_czech"
SOURCE_ORDER = [SOURCE_HC, SOURCE_GM, SOURCE_LC, SOURCE_CZ]
ID_SUFFIX = {SOURCE_HC: "_HC", SOURCE_GM: "_GMSC", SOURCE_LC: "_LC", SOURCE_CZ: "_PKDD"}

# Bureau monthly status codes (fixed values).
BUREAU_BAD_STATUS = ["2", "3", "4", "5"]
BUREAU_UNKNOWN_STATUS = "X"

# Peer-lending loan statuses (fixed values).
LC_ACTIVE_STATUS = ["Current", "In Grace Period", "Late (16-30 days)",
                    "Late (31-120 days)", "Issued"]
LC_DEFAULT_STATUS = ["Charged Off", "Default",
                     "Does not meet the credit policy. Status:Charged Off"]
LC_HIGH_RISK_PURPOSE = ["small_business", "vacation", "moving", "medical", "other"]
LC_EMP_LENGTH_MAP = {"< 1 year": 1, "1 year": 2, "2 years": 2, "3 years": 2,
                     "4 years": 3, "5 years": 3, "6 years": 3, "7 years": 3,
                     "8 years": 4, "9 years": 4, "10+ years": 4, "n/a": 0}
LC_OWNER_HOME = ["MORTGAGE", "OWN"]

# Bank-source loan statuses counted as default (fixed values).
CZ_DEFAULT_STATUS = ["B", "D"]

# Tokens pandas' CSV reader turns into missing values (fixed values).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]

# Score scale and bands (fixed values).
SCORE_MIN = 300
SCORE_MAX = 900
RANDOM_STATE = 42
BANDS = [(750, "Excellent"), (700, "Very Good"), (650, "Good"), (600, "Fair"),
         (550, "Poor")]
BAND_FLOOR = "Very Poor"
RECOMMENDATIONS = [(700, "Approve"), (600, "Conditional")]
RECOMMENDATION_FLOOR = "Reject"

# Feature -> human label for explanations (fixed values).
FEATURE_LABELS = {
    "credit_to_income": "Loan-to-income ratio",
    "annuity_to_income": "Monthly payment burden",
    "inst_late_payment_rate": "Late payment rate",
    "has_savings": "Savings account",
    "savings_account_ordinal": "Savings balance",
    "checking_account_ordinal": "Checking account health",
    "stability_score": "Life stability score",
    "employment_stability": "Job stability",
    "own_realty_flag": "Property ownership",
    "cc_utilization_mean": "Credit card utilization",
    "has_loan_history": "Loan history",
    "credit_history_ordinal": "Credit history quality",
    "bureau_debt_to_credit_ratio": "Debt-to-credit ratio",
    "inst_payment_consistency": "Payment consistency",
    "ext_source_mean": "External credit score",
    "age_years": "Age",
    "debt_ratio": "Debt ratio",
    "total_enquiries": "Credit enquiries",
    "income_per_person": "Income per family member",
    "loan_purpose_high_risk": "Loan purpose risk",
}

# Scoring request: (field, type, default) in request order (fixed values).
REQUEST_FIELDS: list[tuple[str, str, object]] = [
    ("is_new_user", "boolean", False),
    ("annual_income", "double", 480000.0),
    ("loan_amount", "double", 250000.0),
    ("monthly_payment", "double", 8500.0),
    ("loan_term", "int", 36),
    ("dti", "double", 25.0),
    ("has_checking", "boolean", True),
    ("checking_tier", "int", 3),
    ("has_savings", "boolean", True),
    ("savings_amount", "double", 25000.0),
    ("savings_tier", "int", 3),
    ("age", "int", 30),
    ("family_size", "int", 3),
    ("employed", "boolean", True),
    ("employment_years", "double", 4.0),
    ("employment_stability", "int", 3),
    ("owns_property", "boolean", False),
    ("region_rating", "int", 1),
    ("high_risk_purpose", "boolean", False),
    ("has_guarantor", "boolean", False),
    ("existing_credits", "int", 2),
    ("cc_utilization", "double", 0.30),
    ("enquiries", "int", 1),
    ("late_payment_rate", "double", 0.05),
    ("max_days_late", "int", 0),
    ("has_past_delays", "boolean", False),
    ("credit_history", "int", 4),
    ("approval_rate", "double", 0.80),
    ("prev_applications", "int", 2),
    ("docs_rate", "double", 0.85),
]

# Interaction features added before training (name, kind, a, b) (fixed values).
INTERACTIONS = [
    ("risk_amplifier", "mul", "credit_to_income", "inst_late_payment_rate"),
    ("savings_x_employment", "mul", "savings_account_ordinal", "employment_stability"),
    ("util_x_debt", "mul", "cc_utilization_mean", "debt_ratio"),
    ("income_adequacy", "div", "income_per_person", "annuity_amount"),
    ("age_emp_score", "scaled_mul", "age_years", "employment_stability"),
    ("payment_range", "sub", "inst_payment_ratio_mean", "inst_late_payment_rate"),
    ("stability_vs_debt", "ratio1", "stability_score", "credit_to_income"),
]

# Preparation parameters (fixed values).
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99
MAX_FEATURES = 80
FORCED_PER_GROUP = 2
BLEND_WEIGHTS = (0.60, 0.40)
# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------


def _dedupe(names):
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(n)
    return out


ALL_FEATURES: list[str] = _dedupe(f for g in FEATURE_GROUPS.values() for f in g)
FEATURE_GROUP_OF: dict[str, str] = {f: g for g, fs in FEATURE_GROUPS.items() for f in fs}
META_COLUMNS = ["source_id", "TARGET", "source_dataset"]

_SPARK_TYPES = {"boolean": T.BooleanType(), "double": T.DoubleType(), "int": T.IntegerType()}
REQUEST_SCHEMA = T.StructType(
    [T.StructField(n, _SPARK_TYPES[t], True) for n, t, _ in REQUEST_FIELDS])
REQUEST_DEFAULTS = {n: d for n, _, d in REQUEST_FIELDS}

UNIFIED_SCHEMA = T.StructType(
    [T.StructField("source_id", T.StringType(), True),
     T.StructField("TARGET", T.IntegerType(), True),
     T.StructField("source_dataset", T.StringType(), True)]
    + [T.StructField(f, T.DoubleType(), True) for f in ALL_FEATURES])
