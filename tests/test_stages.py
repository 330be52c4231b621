"""One saved pipeline model carries label codes, preparation and trees into another process."""
import json
import os
import subprocess
import sys

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from creditlake.functions import catalog as K
from creditlake.operators import stages as ST

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

OTHER = """
from creditlake.session import get_spark
from pyspark.ml import PipelineModel
spark = get_spark("local[2]", 2)
m = PipelineModel.load({model!r})
m.transform(spark.read.parquet({rows!r})).select("source_id", "p", "margin").write.parquet({out!r})
spark.stop()
"""


def rows(spark, n=500):
    rng = np.random.default_rng(2)
    feats = K.ALL_FEATURES[:14]
    x = rng.normal(size=(n, 14)) * 10
    x[rng.random((n, 14)) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) * 5 > 0).astype(int)
    data = [(f"{i}_LC", int(y[i]), K.SOURCE_LC, ["car", "home", None][i % 3], *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(data, "source_id string, TARGET int, source_dataset string, purpose string, " + ", ".join(f"`{f}` double" for f in feats))


def test_saved_pipeline_scores_alike_in_another_process(spark, tmp_path):
    df = rows(spark)
    model = ST.credit_pipeline({"rounds": 6, "min_rows": 10}, purpose="purpose").fit(df)
    want = {r.source_id: (r.p, r.margin) for r in model.transform(df).collect()}
    assert len({p for p, _ in want.values()}) > 5
    path, src, out = (str(tmp_path / x) for x in ("model", "rows", "out"))
    model.write().overwrite().save(path)
    df.write.parquet(src)
    subprocess.run([sys.executable, "-c", OTHER.format(model=path, rows=src, out=out)], check=True, timeout=240, cwd=str(tmp_path), env={**os.environ, "PYTHONPATH": REPO})
    assert {r.source_id: (r.p, r.margin) for r in spark.read.parquet(out).collect()} == want
    codes, prep, trees = PipelineModel.load(path).stages
    assert codes.fitted() == ["car", "home", "nan"] and set(prep.fitted()) == {"bounds", "fills", "selected", "scales"}
    assert trees.model().features == [f for f in [*K.ALL_FEATURES, *[n for n, *_ in K.INTERACTIONS]] if f in prep.features()]


def test_label_codes_serve_requests_too(spark):
    df = rows(spark, 30)
    m = ST.LabelCodes(inputCol="purpose").fit(df)
    new = spark.createDataFrame([("home",), (None,), ("boat",)], "purpose string")
    assert [r.loan_purpose_encoded for r in m.transform(new).collect()] == [1.0, 2.0, None]
    assert m.transform(new.drop("purpose").withColumn("x", F.lit(1))).select("loan_purpose_encoded").distinct().collect()[0][0] is None
    assert json.loads(m.getOrDefault("state")) == ["car", "home", "nan"]


def test_preparation_keeps_other_columns(spark):
    df = rows(spark, 200).withColumn("note", F.lit("n"))
    m = ST.Preparation().fit(df)
    out = m.transform(df)
    assert {"note", "purpose", "TARGET", "source_id"} <= set(out.columns) and set(m.features()) <= set(out.columns)
    alone = m.transform(df.select("source_id", K.ALL_FEATURES[0]))          # features that are not there count as missing
    assert alone.count() == 200 and set(m.features()) <= set(alone.columns)
