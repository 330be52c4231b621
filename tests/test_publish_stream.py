"""Published versions, rejected lines, and streams that see files twice."""
import os

import pytest
from pyspark.sql import functions as F

from creditlake.operators import boost as B
from creditlake.operators import prep as PR
from creditlake.operators import score as SC
from creditlake.operators.serve import BoostScorer
from creditlake.sources import readers as RD
from creditlake.sources import sinks as SK
from creditlake.streaming import scorer as S

from .conftest import SF001


def table(spark, n):
    return spark.range(n).select(F.concat(F.col("id").cast("string"), F.lit("_HC")).alias("source_id"), (F.col("id") % 2).cast("int").alias("TARGET"),
                                 F.when(F.col("id") % 5 == 0, "b").when(F.col("id") % 7 != 0, "a").alias("source_dataset"), (F.col("id") / 3).alias("x"))


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    assert SK.publish(table(spark, 100), root) == 1 and SK.publish(table(spark, 40), root) == 2
    key = lambda d: sorted(map(tuple, d.select("source_id", "TARGET", "source_dataset", "x").collect()), key=repr)
    assert key(SK.read_published(spark, root)) == key(table(spark, 40)) and key(SK.read_published(spark, root, 1)) == key(table(spark, 100))
    broken = table(spark, 60).withColumn("x", F.when(F.col("source_id") == "59_HC", F.raise_error(F.lit("lost"))).otherwise(F.col("x")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        SK.publish(broken, root)
    assert sorted(SK.versions(spark, root)) == [1, 2] and SK.read_published(spark, root).count() == 40
    assert SK.publish(table(spark, 7), root) == 3 and SK.read_published(spark, root).count() == 7
    with pytest.raises(FileNotFoundError):
        SK.read_published(spark, str(tmp_path / "none"))


def test_lost_files_are_noticed(spark, tmp_path):
    root = str(tmp_path / "t")
    SK.publish(table(spark, 100).repartition(2), root)
    path = SK.versions(spark, root)[1]["path"].removeprefix("file:")
    part = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in sorted(fs) if f.endswith(".parquet"))
    os.remove(part)
    with pytest.raises(SK.PublishError):
        SK.read_published(spark, root)


def test_only_the_given_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    SK.write_table(table(spark, 100), path)
    before = spark.read.parquet(path).filter("source_dataset = 'a'").count()
    SK.write_table(table(spark, 100).filter("source_dataset = 'b'").limit(3), path, dynamic=True)
    got = spark.read.parquet(path)
    assert got.filter("source_dataset = 'b'").count() == 3 and got.filter("source_dataset = 'a'").count() == before


LINES = ["a,b,c", "1,2,3", '"quoted, with comma",5,6', "7,8", "9,10,11,12", '13,"open,14', "", "15,,17", '"he said ""so""",1,2']


def test_rejected_lines_are_kept_and_counted(spark, tmp_path):
    (tmp_path / "f.csv").write_text("\n".join(LINES) + "\n")
    rows, rejects = RD.read_lines_with_rejects(spark, str(tmp_path / "f.csv"))
    assert sorted((r.a, r.b, r.c) for r in rows.collect()) == [("1", "2", "3"), ("15", None, "17"), ('he said "so"', "1", "2"), ("quoted, with comma", "5", "6")]
    assert sorted(r.line for r in rejects.collect()) == ['13,"open,14', "7,8", "9,10,11,12"]
    assert rows.columns == ["a", "b", "c"] and all(r.file.endswith("f.csv") for r in rejects.collect())


def requests(spark):
    from creditlake.sources import driver_roles as DR
    return DR.score_requests(spark, SF001).withColumn("submitted_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_id") % 600))


def test_replayed_files_and_a_restart_change_nothing(spark, tmp_path):
    req = requests(spark)
    src, out, ck, total, tck = (str(tmp_path / x) for x in ("in", "out", "ck", "total", "tck"))
    req.filter("request_id % 2 = 0").write.parquet(f"{src}/a")
    req.filter("request_id % 4 = 0").write.parquet(f"{src}/b")
    run = lambda: S.start_deduplicated(S.request_stream(spark, f"{src}/*", req.schema, max_files_per_trigger=1), out, ck).awaitTermination()
    run()
    S.start_summary(spark, out, total, tck).awaitTermination()
    first = S.latest_summary(spark, total).first()
    assert first["n_total"] == req.filter("request_id % 2 = 0").count()
    req.write.parquet(f"{src}/c")                                  # all of them, after a restart
    run()
    S.start_summary(spark, out, total, tck).awaitTermination()
    names = ["request_id", "credit_score", "status"]
    assert sorted(map(tuple, spark.read.parquet(out).select(*names).collect())) == sorted(map(tuple, S.score_frame(req).select(*names).collect()))
    got, want = S.latest_summary(spark, total).first(), SC.batch_summary(S.score_frame(req)).first()
    assert got["n_total"] == want["n_total"] and got["summary_line"] == want["summary_line"] and abs(got["mean_score"] - want["mean_score"]) < 1e-9


def test_no_task_prepares_all_requests(spark):
    """Every file drop is dealt behind a shuffle; none collapses the plan before it into one task."""
    from creditlake.plans import more_queries as Q
    req = requests(spark)
    drops = Q._drops(req)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in drops]
    assert not [p for p in plans if "Coalesce " in p] and all("REPARTITION_BY_NUM" in p for p in plans)
    ids = [sorted(r.request_id for r in d.select("request_id").collect()) for d in drops]
    every = sorted(r.request_id for r in req.select("request_id").collect())
    assert ids == [every, [i for i in every if i % 3 == 0], every]


def test_boosted_trees_score_stream_and_batch_alike(spark, tmp_path):
    req = requests(spark).limit(60)
    feats = ["income_total", "credit_to_income", "inst_late_payment_rate", "cc_utilization_mean"]
    pm = PR.PrepModel([], [], feats, [{"feature": f, "center": 0.5, "scale": 2.0} for f in feats])
    x = pm.transform(SC.build_applicant_features(req), keep=["request_id"]).withColumn("TARGET", (F.col("request_id") % 3 == 0).cast("int"))
    model = B.fit(x, feats, B.BoostParams(rounds=5, min_rows=3), weight=None, val=None)
    scorer = BoostScorer(model, pm)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    req.write.parquet(src)
    req.write.mode("append").parquet(src)
    saved = spark.read.parquet(src).dropDuplicates(["request_id"])
    S.start_deduplicated(S.request_stream(spark, src, req.schema, max_files_per_trigger=1), out, ck, scorer=scorer).awaitTermination()
    key = lambda d: sorted((r.request_id, r.p, r.credit_score) for r in d.collect())
    assert key(spark.read.parquet(out)) == key(S.score_frame(saved, scorer)) and len({r.p for r in spark.read.parquet(out).collect()}) > 3
