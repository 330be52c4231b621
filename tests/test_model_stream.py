"""Model operators: split shares, attribution additivity, stream = batch."""
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from creditlake.operators import explain as X
from creditlake.operators import model as M
from creditlake.streaming.scorer import score_frame, start_stream

from .conftest import SF001


def test_split_shares(spark):
    df = spark.range(20000).select(F.concat(F.col("id").cast("string"), F.lit("_HC")).alias("source_id"))
    shares = {r.split: r["count"] / 20000 for r in M.assign_split(df).groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.70) < 0.02 and abs(shares["validation"] - 0.15) < 0.02


def test_tree_attribution_additive(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.5, size=600) > 0).astype(int)
    df = spark.createDataFrame([(f"{i}_HC", int(y[i]), *map(float, x[i]), 1.0) for i in range(600)],
                               "source_id string, TARGET int, a double, b double, c double, weight double")
    model = M.gbt_pipeline(["a", "b", "c"], M.TrainParams(max_iter=8, max_depth=3, min_instances_per_node=5),
                           use_validation=False).fit(df)
    att = X.tree_attributions(df, model, ["a", "b", "c"])
    pred = M.positive_probability(model, df).select("source_id", "p")
    j = att.join(pred, "source_id").select(
        (F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda s, v: s + v) - F.col("margin")).alias("e"),
        (1 / (1 + F.exp(-2 * F.col("margin"))) - F.col("p")).alias("d"))
    m = j.agg(F.max(F.abs("e")), F.max(F.abs("d"))).first()
    assert m[0] < 1e-9 and m[1] < 1e-9
    imp = {r.feature: r.mean_abs_attribution for r in X.mean_abs_attribution(att, ["a", "b", "c"]).collect()}
    assert imp["a"] > imp["c"]


def test_stream_equals_batch(spark):
    from creditlake.sources import driver_roles as DR
    req = DR.score_requests(spark, SF001)
    base = tempfile.mkdtemp(prefix="cl-stream-")
    src = os.path.join(base, "in")
    req.write.parquet(src)
    q = start_stream(spark, src, req.schema, os.path.join(base, "out"), os.path.join(base, "ck"))
    q.awaitTermination()
    got = spark.read.parquet(os.path.join(base, "out")).select("request_id", "credit_score", "recommendation")
    exp = score_frame(req).select("request_id", "credit_score", "recommendation")
    assert got.count() == exp.count() == req.count()
    assert got.exceptAll(exp).count() == 0


def test_stream_resumes_from_checkpoint(spark):
    from creditlake.sources import driver_roles as DR
    req = DR.score_requests(spark, SF001)
    base = tempfile.mkdtemp(prefix="cl-resume-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    first = req.filter(F.col("request_id") % 2 == 0)
    second = req.filter(F.col("request_id") % 2 == 1)
    first.write.parquet(os.path.join(src, "a"))
    start_stream(spark, os.path.join(src, "*"), req.schema, out, ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    second.write.parquet(os.path.join(src, "b"))          # new files arrive after a restart
    start_stream(spark, os.path.join(src, "*"), req.schema, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert n1 == first.count()
    assert got.count() == req.count() and got.select("request_id").distinct().count() == req.count()


def test_interaction_guards(spark):
    cols = ["credit_to_income", "inst_late_payment_rate", "income_per_person", "annuity_amount",
            "age_years", "employment_stability", "stability_score"]
    df = spark.createDataFrame([(2.0, 0.5, 100.0, 0.0, 40.0, 3.0, 6.0), (1.0, None, 10.0, 4.0, 30.0, 1.0, 2.0)],
                               ", ".join(f"{c} double" for c in cols))
    inter = M.interaction_columns(df.columns)
    assert set(inter) == {"risk_amplifier", "income_adequacy", "age_emp_score", "stability_vs_debt"}
    r = df.select(*[v.alias(k) for k, v in inter.items()]).collect()
    assert r[0].risk_amplifier == 1.0 and r[0].income_adequacy is None       # zero denominator -> missing
    assert abs(r[1].income_adequacy - 10.0 / (4.0 + 1e-6)) < 1e-12
    assert r[0].age_emp_score == 1.2 and r[0].stability_vs_debt == 2.0
    assert r[1].risk_amplifier is None


def test_saved_model_scores_batch_and_stream_alike(spark, tmp_path):
    from pyspark.sql import functions as F

    from creditlake.functions import catalog as K
    from creditlake.operators import model as M
    from creditlake.operators import prep as PR
    from creditlake.operators.serve import RequestScorer
    from creditlake.sources import sinks as SK
    from creditlake.streaming.scorer import score_frame, start_stream

    req = SK.template_requests(spark).withColumn("request_id", F.monotonically_increasing_id())
    feats = K.ALL_FEATURES[:12]
    rows = [(f"{i}_x", i % 2, "s", *[float((i * (j + 3)) % 17) for j in range(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, TARGET int, source_dataset string, " + ", ".join(f"`{f}` double" for f in feats))
    pm = PR.PrepModel([{"feature": feats[0], "lo": 1.0, "hi": 15.0, "applied": True}], [], list(feats),
                      [{"feature": f, "center": 5.0, "scale": 2.0} for f in feats])
    x = M.with_weight(M.add_interactions(pm.transform(df)), 1.0)
    used = list(feats) + list(M.interaction_columns(x.columns))
    x = x.fillna(0.0, subset=used)
    gbt = M.gbt_pipeline(used, M.TrainParams(max_iter=4, max_depth=3, min_instances_per_node=2), use_validation=False).fit(x)
    own = RequestScorer(gbt, pm, used)
    own.save(str(tmp_path / "m"))
    loaded = RequestScorer.load(str(tmp_path / "m"))
    assert loaded.prep == pm and loaded.features == used
    key = lambda d: sorted((r.request_id, round(r.p, 12), r.credit_score, r.status) for r in d.collect())
    batch = key(score_frame(req, loaded))
    assert batch == key(score_frame(req, own)) and len(batch) == req.count() and all(0 <= b[1] <= 1 for b in batch)
    req.write.parquet(str(tmp_path / "in"))
    start_stream(spark, str(tmp_path / "in"), req.schema, str(tmp_path / "out"), str(tmp_path / "ck"), scorer=loaded).awaitTermination()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == batch
    assert max(abs(r.margin - r.model_margin) for r in loaded.factors(req).collect()) < 1e-9


def test_tune_query_runs_the_whole_search_and_trains_the_winner(monkeypatch):
    """M9: the registered query keeps the operator's 50 trials of 100 rounds and fits the best one's parameters."""
    import inspect
    from types import SimpleNamespace

    from creditlake.operators import boost as B
    from creditlake.operators import evaluate as EV
    from creditlake.operators import search as SE
    from creditlake.plans import more_queries as Q
    from creditlake.plans import pipeline as PL
    assert inspect.signature(SE.tune).parameters["n_trials"].default == 50 and B.BoostParams().rounds == 100
    seen = {}
    sampler = SE.Sampler(SE.SPACE, 1)
    drawn = [sampler.ask() for _ in range(50)]

    class Data:
        def filter(self, _):
            return self

    def search(rows, features, **kw):
        seen["search"] = kw
        return [{**p, "score": 0.9 if i == 7 else 0.5, "rounds": 3, "loss": 0.1} for i, p in enumerate(drawn)]

    def final(rows, features, params):
        seen["params"] = params
        return "final"

    monkeypatch.setattr(PL, "boost_data", lambda spark, sf_dir: SimpleNamespace(data=Data(), features=["a"]))
    monkeypatch.setattr(PL, "boost_predictions", lambda t, model: model)
    monkeypatch.setattr(EV, "roc_auc", lambda pred: SimpleNamespace(first=lambda: {"auc": 0.75 if pred == "final" else 0.0}))
    monkeypatch.setattr(SE, "tune", search)
    monkeypatch.setattr(B, "fit", final)
    monkeypatch.setattr(Q, "F", SimpleNamespace(col=lambda c: SimpleNamespace(__eq__=lambda s, o: True, isin=lambda *a: True)))
    rows = Q.q_tune(SimpleNamespace(createDataFrame=lambda rows, schema: rows), "sf")
    assert seen["search"] == {} and len(rows) == 50
    assert all(getattr(seen["params"], k) == v for k, v in drawn[7].items()) and seen["params"].rounds == 100
    assert [r[0] for r in rows if r[-2]] == [7] and rows[7][-1] == 0.75 and all(r[-1] is None for r in rows if not r[-2])


def test_stratified_split_is_exact_within_classes(spark):
    import hashlib
    rows = [(f"{i}_HC", [0, 0, 0, 1, None][i % 5] if i % 7 else 1) for i in range(1003)]
    df = spark.createDataFrame(rows, "source_id string, TARGET int").repartition(5)
    got = {r.source_id: r.split for r in M.assign_stratified(df).collect()}
    for label in (0, 1, None):
        ids = sorted((i for i, t in rows if t == label), key=lambda i: int(hashlib.md5(f"{i}42".encode()).hexdigest()[:15], 16))
        n = len(ids)
        a, b = (n * 70 + 50) // 100, (n * 85 + 50) // 100
        assert [got[i] for i in ids] == ["train"] * a + ["validation"] * (b - a) + ["test"] * (n - b)
    one = M.assign_stratified(spark.createDataFrame([("1_HC", 1)], "source_id string, TARGET int")).collect()
    assert [r.split for r in one] == ["train"]
    assert M.assign_stratified(df.limit(0)).collect() == []


def test_factors_are_ranked_once(spark):
    """magnitudes descending, ties in feature order, at most 20, four a side; one sort in the plan."""
    from creditlake.functions.catalog import FEATURE_LABELS
    feats = [f"some_feature{i:02d}" for i in range(25)] + list(FEATURE_LABELS)[:5]
    rng = np.random.default_rng(7)
    rows = [[float(v) for v in np.round(rng.normal(0, 0.02, len(feats)), 2)] for _ in range(40)]
    rows += [[0.0] * len(feats), [0.0005] * len(feats), [0.5] * len(feats), [-0.5] * len(feats), [float("nan"), -1.0] + [0.3] * (len(feats) - 2)]
    df = spark.createDataFrame(list(enumerate(rows)), "source_id long, attributions array<double>")
    out = X.factors(df, feats)
    got = {r.source_id: (r.positive_factors, r.negative_factors) for r in out.collect()}

    def label(i):
        return FEATURE_LABELS.get(feats[i]) or " ".join(w.capitalize() for w in feats[i].split("_"))

    for k, vs in enumerate(rows):
        order = sorted(range(len(feats)), key=lambda i: (-np.inf if np.isnan(vs[i]) else -abs(vs[i]), i))[:X.TOP_K]
        big = [i for i in order if np.isnan(vs[i]) or abs(vs[i]) >= X.MIN_ABS]
        assert got[k] == ([label(i) for i in big if vs[i] < 0][:X.PER_SIDE], [label(i) for i in big if not vs[i] < 0][:X.PER_SIDE])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and "array_sort(" not in plan


def test_model_metrics_scores_the_test_rows_once(spark, monkeypatch):
    """AUC and KS are read from one table of the scores."""
    from creditlake.operators import evaluate as EV
    from creditlake.plans import more_queries as Q
    from creditlake.plans import pipeline as PL
    rng = np.random.default_rng(3)
    pred = spark.createDataFrame([(int(rng.random() < p), float(p)) for p in np.round(rng.random(300), 2)], "TARGET int, p double")
    auc, ks = EV.roc_auc(pred).first(), EV.ks_statistic(pred).first()["ks"]
    made, real = [], EV.roc_table
    monkeypatch.setattr(EV, "roc_table", lambda *a, **k: made.append(1) or real(*a, **k))
    monkeypatch.setattr(PL, "train", lambda spark, sf_dir: None)
    monkeypatch.setattr(PL, "test_predictions", lambda t: pred)
    got = Q.q_model_metrics(spark, "anywhere").collect()
    assert [tuple(r) for r in got] == [(*auc, ks)] and len(made) == 1


def test_training_runs_compiled_methods_and_puts_the_setting_back(spark, monkeypatch):
    """wide plans of the training aren't left as methods that the JVM interprets."""
    from creditlake.plans import pipeline as PL
    key, seen = "spark.sql.codegen.hugeMethodLimit", []

    def stop(spark, *a, **k):
        seen.append(int(spark.conf.get(key)))
        raise KeyError("stop")

    monkeypatch.setattr(PL, "prepared", stop)
    before = spark.conf.get(key)
    try:
        PL.train(spark, "/nowhere")
    except KeyError:
        pass
    assert seen == [8000] and spark.conf.get(key) == before
