"""Golden scoring values."""
from pyspark.sql import functions as F

from creditlake.functions import catalog as K
from creditlake.operators import score as SC


def test_prob_to_score_golden(spark):
    df = spark.createDataFrame([(0.5,), (0.018,), (0.001,), (0.982,), (0.999,), (None,)], "p double")
    s = [r.s for r in df.select(SC.prob_to_score(F.col("p")).alias("s")).collect()]
    assert s[0] == 600 and s[1] == 900 and s[2] == 900 and s[3] == 300 and s[4] == 300 and s[5] is None


def test_bands_and_recommendations(spark):
    df = spark.createDataFrame([(750,), (749,), (700,), (650,), (600,), (550,), (549,)], "s int")
    r = df.select(SC.band(F.col("s")).alias("b"), SC.recommendation(F.col("s")).alias("r")).collect()
    assert [x.b for x in r] == ["Excellent", "Very Good", "Very Good", "Good", "Fair", "Poor", "Very Poor"]
    assert [x.r for x in r] == ["Approve", "Approve", "Approve", "Conditional", "Conditional", "Reject", "Reject"]


TEMPLATE_HIGH_RISK = dict(annual_income=240000.0, loan_amount=320000.0, monthly_payment=12000.0, loan_term=36, dti=55.0,
                          has_checking=True, checking_tier=1, has_savings=False, savings_amount=0.0, savings_tier=0,
                          age=25, family_size=2, employed=True, employment_years=1.0, employment_stability=1,
                          owns_property=False, region_rating=3, high_risk_purpose=True, has_guarantor=False,
                          existing_credits=5, cc_utilization=0.85, enquiries=8, late_payment_rate=0.30,
                          max_days_late=90, has_past_delays=True, credit_history=1, approval_rate=0.40,
                          prev_applications=6, docs_rate=0.60, is_new_user=False)


def test_applicant_features_template(spark):
    df = spark.createDataFrame([tuple(TEMPLATE_HIGH_RISK[n] for n, _, _ in K.REQUEST_FIELDS)], K.REQUEST_SCHEMA)
    r = SC.build_applicant_features(df).first()
    assert r.credit_to_income == 320000 / 240001
    assert r.bureau_bad_status_months == 7.0          # int(0.30 * 24)
    assert r.has_critical_account == 1.0 and r.bureau_active_credit_ratio == 0.5
    assert r.stability_score == 1 + 0 + 1 + 0 and r.children_count == 1.0
    assert r.inst_early_payment_rate == 0.0 and r.ext_source_mean == 0.55
    assert r.present_residence_since is None
    tips = df.select(SC.improvement_tips(df).alias("t")).first().t
    assert tips == ["Lower CC utilization — 85% (target <30%)",
                    "Improve payment punctuality — 30.0% late (target <5%)",
                    "Open a savings account — strong positive signal",
                    "Reduce credit enquiries — 8 detected (target <5)"]
    km = df.select(*[v.alias(k) for k, v in SC.key_metrics(df).items()]).first()
    assert km.km_credit_to_income == 1.33 and km.km_payment_burden_pct == 60.0 and not km.ok_payment_burden


def test_new_user_and_defaults(spark):
    df = spark.createDataFrame([("abc", None, "yes"), ("100", "5", "1.0"), ("", None, None)],
                               "annual_income string, loan_amount string, is_new_user string")
    st = [r.s for r in df.select(SC.request_validity(df).alias("s")).collect()]
    assert st[0].startswith("error") and st[1] == "success" and st[2] == "success"
    f = SC.build_applicant_features(df).collect()
    assert f[1].income_total == 100.0 and f[1].credit_amount == 5.0 and f[1].ext_source_count == 0.0
    assert f[2].income_total == 480000.0 and f[2].has_loan_history == 1.0
    scored = SC.score_outputs(df.withColumn("p", F.lit(0.5)), F.col("p")).collect()
    assert scored[0].recommendation == "Error" and scored[0].credit_score is None
    assert scored[1].credit_score == 600 and scored[1].score_band == "Fair"


def test_batch_summary_row(spark):
    df = spark.createDataFrame([(1, 700, 10.0, "Approve", "success"), (2, None, None, "Error", "error: x"),
                                (3, 601, 20.0, "Conditional", "success")],
                               "request_id int, credit_score int, default_probability_pct double, recommendation string, status string")
    s = SC.batch_summary(df).first()
    assert s.summary_line == "=== SUMMARY: 2/3 scored ===" and s.summary_score == "Avg score: 650"
    assert s.summary_recommendations == "Approve:1 | Conditional:1 | Reject:0"
    full = SC.append_summary_row(df, SC.batch_summary(df)).collect()
    assert len(full) == 4 and full[-1].credit_score == "=== SUMMARY: 2/3 scored ==="
