"""Readers and sinks on small files written to a scratch folder."""
import os
import tempfile

from pyspark.sql import functions as F

from creditlake.functions import catalog as K
from creditlake.operators import model as M
from creditlake.operators import score as SC
from creditlake.sources import readers as RD
from creditlake.sources import sinks as SK

from .conftest import SF001


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_semicolon_source_with_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="cl-src-")
    _write(os.path.join(d, "trans", "part.csv"),
           "trans_id;account_id;type;amount;balance;extra\n1;7;PRIJEM;10.5;NA\n2;7;n/a;x;-3\n3;8;VYDAJ;;4.0\n")
    df = RD.read_source(spark, "pkdd_trans", os.path.join(d, "trans"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "bigint", "string", "double", "double"]
    r = {x.trans_id: x for x in df.collect()}
    assert r[1].balance is None and r[1].amount == 10.5
    assert r[2].type is None and r[2].amount is None          # 'n/a' text and bad number -> NULL
    assert r[3].amount is None and r[3].balance == 4.0


def test_tolerant_subset_and_index_column(spark):
    d = tempfile.mkdtemp(prefix="cl-src-")
    _write(os.path.join(d, "gm", "part.csv"),
           ",SeriousDlqin2yrs,age,MonthlyIncome\n0,1,45,NA\n1,0,30.0,5000\n")
    df = RD.read_source(spark, "gmsc", os.path.join(d, "gm"))
    assert "NumberOfDependents" in df.columns                 # absent column -> typed NULL
    rows = RD.index_column(df).orderBy("row_id").collect()
    assert [r.row_id for r in rows] == [0, 1] and rows[1].age == 30 and rows[0].MonthlyIncome is None


def test_request_batch_headers_and_errors(spark):
    d = tempfile.mkdtemp(prefix="cl-src-")
    _write(os.path.join(d, "b", "part.csv"),
           " Annual Income ,Loan Amount,Has Savings\n100000,5000,yes\nabc,5000,NA\n")
    up = RD.read_request_batch(spark, os.path.join(d, "b"))
    assert up.columns == ["annual_income", "loan_amount", "has_savings"]
    st = [r.s for r in up.select(SC.request_validity(up).alias("s")).collect()]
    assert st[0] == "success" and st[1].startswith("error")


def test_audit_counts(spark):
    a = {r.table_name: r for r in RD.audit(spark, {t: f"{SF001}/{t}.parquet" for t in ("customer", "orders")},
                                          {"customer": RD.SOURCE_SCHEMAS["pkdd_account"]}).collect()}
    assert a["orders"].n_rows == spark.read.parquet(f"{SF001}/orders.parquet").count()
    assert a["customer"].missing_columns == ["account_id"] and a["customer"].n_columns == 5


def test_template_scored_batch_file(spark):
    req = SK.template_requests(spark)
    assert req.count() == 5 and req.columns == [n for n, _, _ in K.REQUEST_FIELDS]
    scored = SC.score_outputs(req.withColumn("p", F.lit(0.2)), F.col("p"))
    out = os.path.join(tempfile.mkdtemp(prefix="cl-sink-"), "scored")
    SK.write_scored_batch(scored, out)
    back = spark.read.option("header", True).csv(out).collect()
    assert len(back) == 6 and sum(1 for r in back if (r.credit_score or "").startswith("=== SUMMARY: 5/5")) == 1


def test_model_round_trip(spark):
    df = spark.createDataFrame([(f"{i}_HC", i % 2, float(i % 7), float(i % 3), 1.0) for i in range(200)],
                               "source_id string, TARGET int, a double, b double, weight double")
    model = M.gbt_pipeline(["a", "b"], M.TrainParams(max_iter=3, max_depth=2, min_instances_per_node=1),
                           use_validation=False).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="cl-model-"), "m")
    SK.save_model(model, {"selected": ["a", "b"]}, {"auc": 0.5}, path)
    loaded, meta = SK.load_model(path)
    assert meta["prep"]["selected"] == ["a", "b"]
    p1 = M.positive_probability(model, df).select("source_id", "p")
    p2 = M.positive_probability(loaded, df).select("source_id", "p")
    assert p1.exceptAll(p2).count() == 0
