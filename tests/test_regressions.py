"""Wrong results that once went unnoticed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.functions import catalog as K
from creditlake.operators import explain as X
from creditlake.operators import features as FE
from creditlake.operators import model as M
from creditlake.operators import prep as PR
from creditlake.operators import profile as P
from creditlake.operators import score as SC
from creditlake.sources import readers as RD


def test_correlation_of_columns_that_overlap_far_from_their_means(spark):
    a, b = K.ALL_FEATURES[:2]
    rng = np.random.default_rng(1)
    x = 1e-3 + 1e-5 * rng.standard_normal(500)
    y = x * 0.5 + 1e-5 * rng.standard_normal(500)
    rows = [(float(p), float(q), 0) for p, q in zip(x, y)] + [(50.0 + i, None, 1) for i in range(4000)] + [(None, -900.0 - i, 0) for i in range(4000)]
    df = spark.createDataFrame(rows, f"{a} double, {b} double, TARGET int").repartition(5)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in P.corr_matrix(df, 2).collect()}
    assert got[(a, b)] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


def test_merged_co_moments_equal_those_of_the_whole():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 4)) + 1e6
    v[rng.random(v.shape) < 0.3] = np.nan
    v[:100, 3] = np.nan
    whole = P._co_moments(v)
    parts = P._co_moments(v[:100])
    for lo in (100, 101, 250):
        parts = P._merge_co_moments(parts, P._co_moments(v[lo:{100: 101, 101: 250, 250: 300}[lo]]))
    for p, q in zip(whole, parts):
        assert np.allclose(p, q, rtol=1e-9, atol=1e-7)


def test_reader_keeps_wide_columns_and_exact_integers(spark, tmp_path):
    path = tmp_path / "app.csv"
    path.write_text("SK_ID_CURR,TARGET,DAYS_EMPLOYED,FLAG_DOCUMENT_2,FLAG_DOCUMENT_3,AMT_REQ_CREDIT_BUREAU_MON,AMT_REQ_CREDIT_BUREAU_YEAR,x\n"
                    "9007199254740993,1,,1,0,4,3,y\n2,99999999999,-10.0,1,1,,3,y\n")
    got = RD.read_source(spark, "hc_main", str(path)).orderBy(F.desc("SK_ID_CURR")).collect()
    assert [r.SK_ID_CURR for r in got] == [9007199254740993, 2] and [r.TARGET for r in got] == [1, None]
    assert [r.DAYS_EMPLOYED for r in got] == [None, -10] and [r.FLAG_DOCUMENT_3 for r in got] == [0, 1] and "x" not in got[0]
    df = RD.read_source(spark, "hc_main", str(path)).orderBy(F.desc("SK_ID_CURR"))
    f = FE.applicant_base_features(df)
    row = df.select(f["docs_submission_rate"].alias("d"), f["total_enquiries"].alias("e"), f["employment_years"].alias("y")).collect()
    assert [(r.d, r.e, r.y) for r in row] == [(0.5, 7.0, None), (1.0, 3.0, 0.0)]


def test_ids_are_given_at_ingest_and_the_split_needs_them(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 3.0)], "id long, v double")
    got = RD.with_ids(df)
    assert got.select("id").distinct().count() == 3 and sorted(got.collect()) == sorted(got.collect())
    own = spark.createDataFrame([(7, 1.0)], "id long, v double")
    assert RD.with_ids(own) is own
    with pytest.raises(Exception, match="need ids"):
        M.assign_split(spark.createDataFrame([(None,)], "source_id string")).collect()


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("B",)], "k string")
    got = {r.k: r.code for r in FE.label_codes(df, "k", "code").collect()}
    assert got == {"B": 0.0, "a": 1.0, "b": 2.0, None: 3.0, "é": 4.0}
    served = FE.label_codes(spark.createDataFrame([("a",), ("new",)], "k string"), "k", "code", ["a", "b"])
    assert [r.code for r in served.collect()] == [0.0, None]
    assert "Join" not in served._jdf.queryExecution().toString() and "Window" not in served._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="more than 2 classes"):
        FE.fit_labels(df, "k", 2)


def test_attributions_follow_the_model_on_missing_values(spark):
    rng = np.random.default_rng(3)
    rows = [(str(i), *(float(v) for v in rng.standard_normal(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "source_id string, a double, b double, c double").withColumn(
        "TARGET", ((F.col("a") - F.col("b")) > 0).cast("int"))
    train = M.with_weight(df, 1.0)
    feats = ["a", "b", "c"]
    model = M.gbt_pipeline(feats, M.TrainParams(max_iter=5, max_depth=3, min_instances_per_node=5), use_validation=False).fit(train)
    holes = train.withColumn("a", F.when(F.hash("source_id") % 3 != 0, F.col("a"))).withColumn("b", F.when(F.hash("source_id") % 5 != 0, F.col("b")))
    got = X.tree_attributions(holes, model, feats).collect()
    assert max(abs(r.margin - r.model_margin) for r in got) < 1e-9 and len(got) == 400


def test_months_are_truncated_towards_zero(spark):
    row = spark.createDataFrame([("-0.02",)], "late_payment_rate string")
    assert row.select(SC.applicant_features(row)["bureau_bad_status_months"].alias("m")).first().m == 0.0


def test_feature_complete_when_fitted_is_filled_when_missing(spark):
    f = K.ALL_FEATURES[0]
    pm = PR.PrepModel([], [], [f], [{"feature": f, "center": 4.0, "scale": 2.0}])
    df = spark.createDataFrame([("1", 0, "s", None), ("2", 0, "s", 8.0)], f"source_id string, TARGET int, source_dataset string, {f} double")
    assert sorted(r[f] for r in pm.transform(df).collect()) == [0.0, 2.0]


def test_class_weight_is_that_of_the_profile(spark):
    df = spark.createDataFrame([(0,)] * 1005 + [(1,)] * 200, "TARGET int")
    assert M.class_weight(df) == P.class_balance(df).first()["class_weight"]


def test_audit_reports_absent_files_and_bytes(spark, tmp_path):
    (tmp_path / "pos.csv").write_text("SK_ID_CURR,SK_DPD\n1,2\n")
    got = {r.table_name: r for r in RD.audit(spark, {"hc_pos": str(tmp_path / "pos.csv"), "hc_cc": str(tmp_path / "none.csv")}, RD.SOURCE_SCHEMAS).collect()}
    assert got["hc_pos"].present and got["hc_pos"].n_rows == 1 and got["hc_pos"].n_bytes == 22
    assert got["hc_pos"].missing_columns == ["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"]
    assert not got["hc_cc"].present and got["hc_cc"].n_rows is None and "SK_DPD" in got["hc_cc"].missing_columns


def test_roc_curve_starts_at_zero(spark):
    from creditlake.operators import evaluate as EV

    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.2)], "TARGET int, p double")
    got = sorted((r.fpr, r.tpr, r.threshold) for r in EV.roc_curve(df).collect() if r.threshold is not None)
    assert got == [(0.0, 0.5, 0.9), (1.0, 1.0, 0.2)] and EV.roc_curve(df).where("threshold is null and tpr = 0 and fpr = 0").count() == 1
