"""Profiling, preparation, scoring, evaluation and model queries
(registered on import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import prep as PR
from ..operators import profile as P
from ..operators import score as SC
from . import sources as S
from .queries import register


def _u(spark, sf_dir):
    return S.unified(spark, sf_dir)


# ---------------------------------------------------------------- profile
@register("dataset_overview")
def q_dataset_overview(spark, sf_dir):
    """A8."""
    return P.dataset_overview(_u(spark, sf_dir))


@register("source_counts")
def q_source_counts(spark, sf_dir):
    """A9 (+A10 by source)."""
    return P.source_counts(_u(spark, sf_dir))


@register("default_rate_by_key")
def q_default_rate_by_key(spark, sf_dir):
    """A10 over all profile keys in one pass (grouping sets)."""
    return P.default_rate_by_key(_u(spark, sf_dir))


@register("missing_rates")
def q_missing_rates(spark, sf_dir):
    """A11 + A13."""
    return P.missing_rates(_u(spark, sf_dir))


@register("top_missing")
def q_top_missing(spark, sf_dir):
    """T1 (top-k is the feature)."""
    return P.top_missing(_u(spark, sf_dir), 30)


@register("coverage_by_source")
def q_coverage(spark, sf_dir):
    """A12."""
    return P.coverage_by_source(_u(spark, sf_dir))


@register("class_balance")
def q_class_balance(spark, sf_dir):
    """A14 + A23."""
    return P.class_balance(_u(spark, sf_dir))


@register("cohort_rates")
def q_cohort_rates(spark, sf_dir):
    """A15."""
    return P.cohort_rates(_u(spark, sf_dir))


@register("corr_matrix")
def q_corr(spark, sf_dir):
    """A16."""
    return P.corr_matrix(_u(spark, sf_dir))


@register("label_correlations")
def q_label_corr(spark, sf_dir):
    """T6."""
    return P.label_correlations(_u(spark, sf_dir))


@register("quantiles")
def q_quantiles(spark, sf_dir):
    """A18 (exact, interpolated)."""
    return P.quantiles(_u(spark, sf_dir))


@register("key_stats")
def q_key_stats(spark, sf_dir):
    """A21 (+A19 medians)."""
    return P.key_stats(_u(spark, sf_dir))


@register("class_histogram")
def q_class_histogram(spark, sf_dir):
    """A17."""
    return P.class_histogram(_u(spark, sf_dir))


# ------------------------------------------------------------------- prep
def _cleaned(spark, sf_dir):
    return PR.clean(_u(spark, sf_dir))


def _cleaned_ckpt(spark, sf_dir):
    """Cleaned table read from files of the shared checkpoint folder: the fit
    steps below each run an action over it."""
    return PR.clean(_u(spark, sf_dir), written=True)


def _winsorized(c, stats):
    bounds = [r.asDict() for r in PR.winsor_bounds(c, materialize=False, stats=stats).collect()]  # one row per feature
    return PR.apply_winsor(c, bounds)


def _imputed(c):
    """The cleaned table clipped and filled, and the order statistics it was fitted from."""
    stats = PR.order_stats(c)
    w = _winsorized(c, stats)
    fills = [r.asDict() for r in PR.impute_params(w, materialize=False, stats=stats).collect()]  # one row per feature
    return PR.apply_impute(w, fills), stats


@register("dedup_keep_first")
def q_dedup(spark, sf_dir):
    """M1 = F2 + U2."""
    return _cleaned(spark, sf_dir)


@register("dedup_with_copies")
def q_dedup_copies(spark, sf_dir):
    """M1 = F2 + U2 on rows that do hold duplicates and missing labels."""
    return PR.clean(S.unified_with_copies(spark, sf_dir))


@register("prepared_table")
def q_prepared(spark, sf_dir):
    """M1-M6 as rows: deduplicated, clipped, filled, selected (others NULL),
    scaled, with interactions; fitted on all rows."""
    from ..functions import catalog as K
    from ..operators import model as M
    c = _cleaned_ckpt(spark, sf_dir)
    x = M.add_interactions(PR.fit_prep(c).transform(c))
    names = [*K.ALL_FEATURES, *[n for n, *_ in K.INTERACTIONS]]
    return x.select(*K.META_COLUMNS, *[(F.col(f) if f in x.columns else F.lit(None)).cast("double").alias(f) for f in names])


@register("winsorize")
def q_winsorize(spark, sf_dir):
    """M2: bounds and clip counts per feature."""
    c = _cleaned_ckpt(spark, sf_dir)
    return PR.winsor_report(c, PR.winsor_bounds(c, materialize=False))


@register("impute_median")
def q_impute(spark, sf_dir):
    """M3: fill plan per feature (fitted on winsorized data)."""
    c = _cleaned_ckpt(spark, sf_dir)
    stats = PR.order_stats(c)
    return PR.impute_params(_winsorized(c, stats), materialize=False, stats=stats)


@register("anova_f")
def q_anova(spark, sf_dir):
    """A20 on the features not forced in by group."""
    imp, _ = _imputed(_cleaned_ckpt(spark, sf_dir))
    avail = P.features_of(imp)
    forced = PR.forced_features(avail)
    return PR.anova_f(imp, [f for f in avail if f not in forced])


@register("select_topk")
def q_select(spark, sf_dir):
    """M4 + T2."""
    return PR.select_features(_imputed(_cleaned_ckpt(spark, sf_dir))[0])


@register("robust_scale")
def q_scale(spark, sf_dir):
    """M5: centre and scale of each selected feature."""
    imp, stats = _imputed(_cleaned_ckpt(spark, sf_dir))
    sel = [r["feature"] for r in PR.select_features(imp).collect()]  # one row per feature
    return PR.robust_params(imp, sel, materialize=False, stats=stats)


# ---------------------------------------------------------------- scoring
def _requests(spark, sf_dir):
    from ..sources import driver_roles as DR
    return DR.score_requests(spark, sf_dir)


def scored_requests(spark, sf_dir):
    """Requests scored with the fixed linear stand-in model (P24 -> P27-P29)."""
    req = _requests(spark, sf_dir)
    feats = SC.applicant_features(req)
    with_p = req.select("request_id", SC.linear_probability(feats).alias("p"))
    return SC.score_outputs(with_p, F.col("p"), status=F.lit("success"))


def labelled_scores(spark, sf_dir):
    from ..sources import driver_roles as DR
    lab = DR.read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), (F.col("c_acctbal") < 0).cast("int").alias("TARGET"))
    return scored_requests(spark, sf_dir).select("request_id", "p").join(lab, "request_id")


@register("applicant_features")
def q_applicant_features(spark, sf_dir):
    """Request fields -> 84 catalogue features."""
    return SC.build_applicant_features(_requests(spark, sf_dir))


@register("score_from_prob")
def q_score(spark, sf_dir):
    """P27-P29 + M15: probability -> score, band, recommendation, status."""
    return scored_requests(spark, sf_dir).select(
        "request_id", "p", "credit_score", "score_band", "default_probability_pct", "recommendation", "status")


@register("tips_and_metrics")
def q_tips(spark, sf_dir):
    """Improvement tips, key metrics and their health flags."""
    req = _requests(spark, sf_dir)
    km = SC.key_metrics(req)
    return req.select("request_id", SC.improvement_tips(req).alias("improvement_tips"),
                      *[v.alias(k) for k, v in km.items()])


@register("request_rules")
def q_request_rules(spark, sf_dir):
    """Input-domain rules each request breaks (after coercion)."""
    req = _requests(spark, sf_dir)
    return req.select("request_id", SC.input_rule_violations(req).alias("violations"))


@register("batch_summary")
def q_batch_summary(spark, sf_dir):
    """A22 + U3 summary line."""
    return SC.batch_summary(scored_requests(spark, sf_dir))


# ------------------------------------------------------------- evaluation
@register("roc_auc")
def q_auc(spark, sf_dir):
    """E1 + E2."""
    return EV.roc_auc(labelled_scores(spark, sf_dir))


@register("roc_curve")
def q_roc(spark, sf_dir):
    """E3."""
    return EV.roc_curve(labelled_scores(spark, sf_dir))


@register("ks_stat")
def q_ks(spark, sf_dir):
    """E4."""
    return EV.ks_statistic(labelled_scores(spark, sf_dir))


@register("confusion")
def q_confusion(spark, sf_dir):
    """E5 + E6."""
    return EV.confusion(labelled_scores(spark, sf_dir))


@register("class_report")
def q_report(spark, sf_dir):
    """E7."""
    return EV.class_report(labelled_scores(spark, sf_dir))


# ------------------------------------------------------------------ model
@register("interactions")
def q_interactions(spark, sf_dir):
    """Interaction features over the unified table."""
    from ..operators import model as M
    u = _u(spark, sf_dir)
    cols = M.interaction_columns(u.columns)
    return u.select("source_id", *[v.alias(k) for k, v in cols.items()])


@register("split_assign")
def q_split(spark, sf_dir):
    """M8: the split of every row (hash-bucket 70/15/15 split)."""
    from ..operators import model as M
    return M.assign_split(_u(spark, sf_dir)).select("source_id", "TARGET", "split")


@register("split_stratified")
def q_split_stratified(spark, sf_dir):
    """M8: the exact 70/15/15 split within each class, of every row."""
    from ..operators import model as M
    from ..session import cut_lineage
    u = cut_lineage(_u(spark, sf_dir).select("source_id", "TARGET"), "split-input")
    return M.assign_stratified(u)


@register("tune_gbt")
def q_tune(spark, sf_dir):
    """M9: 50 trials of a Parzen sampler, each trained on all training rows and
    scored by validation AUC; the best trial's parameters train the final model,
    whose AUC on the test split stands in that trial's row (no oracle)."""
    from ..operators import boost as B
    from ..operators import search as SE
    from . import pipeline as PL
    t = PL.boost_data(spark, sf_dir)
    fit_rows = t.data.filter(F.col("split").isin("train", "validation"))
    trials = SE.tune(fit_rows, t.features)
    best = max(range(len(trials)), key=lambda i: (trials[i]["score"] or 0.0, -i))
    final = B.fit(fit_rows, t.features, SE.best_params(trials))
    test_auc = EV.roc_auc(PL.boost_predictions(t, final)).first()["auc"]  # one number
    names = list(SE.SPACE)
    kinds = ", ".join(f"{k} {'int' if r.whole else 'double'}" for k, r in SE.SPACE.items())
    rows = [(i, *[r[k] for k in names], r["rounds"], r["score"], i == best, test_auc if i == best else None) for i, r in enumerate(trials)]
    return spark.createDataFrame(rows, f"trial int, {kinds}, rounds int, val_auc double, chosen boolean, test_auc double")


@register("boost_root_gains")
def q_root_gains(spark, sf_dir):
    """Best gain of the first split per feature of the cleaned, unprepared
    table, missing values on the side that gains more."""
    from ..operators import boost as B
    c = _cleaned_ckpt(spark, sf_dir)
    return B.root_gains(c, P.features_of(c))


@register("boost_score")
def q_boost_score(spark, sf_dir):
    """M10 + M13 + P27-P29: boosted trees with a learned missing side, trained
    on the stratified training split without filling undefined values; test
    split scored (no oracle: a trained model)."""
    from . import pipeline as PL
    pred = PL.boost_predictions(PL.boosted(spark, sf_dir))
    return SC.score_outputs(pred.drop("margin"), F.col("p"), status=F.lit("success"))


@register("boost_metrics")
def q_boost_metrics(spark, sf_dir):
    """E1-E4 of the boosted trees on the test split, and the trees kept (no oracle)."""
    from . import pipeline as PL
    t = PL.boosted(spark, sf_dir)
    pred = PL.boost_predictions(t)
    table = EV.roc_table(pred)  # scores the split once, for both
    ks = EV.ks_statistic(pred, table=table).first()["ks"]  # one number
    return EV.roc_auc(pred, table=table).withColumn("ks", F.lit(ks)).withColumn("n_trees", F.lit(len(t.model.trees)))


def _shapley(spark, sf_dir):
    from ..operators import shapley as SH
    from . import pipeline as PL
    t = PL.boosted(spark, sf_dir)
    return SH.shapley_values(t.data.filter(F.col("split") == "test"), t.model), t.features


@register("shapley_factors")
def q_shapley(spark, sf_dir):
    """M14 + T4 + F6 + P34: exact Shapley values of every test row and the top
    factors either way (no oracle; additivity_error is 0)."""
    from ..operators import explain as X
    att, feats = _shapley(spark, sf_dir)
    return X.factors(att, feats).select(
        "source_id", "base", "margin", (F.col("margin") - F.col("model_margin")).alias("additivity_error"),
        "positive_factors", "negative_factors")


@register("shapley_importance")
def q_shapley_importance(spark, sf_dir):
    """A25 + T5: mean |Shapley value| per feature, top 25 (no oracle)."""
    from ..operators import explain as X
    att, feats = _shapley(spark, sf_dir)
    return X.mean_abs_attribution(att, feats).orderBy(F.desc("mean_abs_attribution"), "feature").limit(25)


@register("shapley_additivity")
def q_shapley_additivity(spark, sf_dir):
    """Per class of the test split, its rows and how many of them have
    values that don't add up to the model's margin (1e-9)."""
    from ..operators import shapley as SH
    from . import pipeline as PL
    t = PL.boosted(spark, sf_dir)
    att = SH.shapley_values(t.data.filter(F.col("split") == "test"), t.model, keep=["TARGET"])
    total = F.col("base") + F.aggregate("attributions", F.lit(0.0), lambda a, b: a + b)
    return att.groupBy("TARGET").agg(F.count("*").alias("n_rows"), F.count_if(F.abs(total - F.col("model_margin")) > 1e-9).alias("n_off"))


@register("missing_before_after")
def q_missing_before_after(spark, sf_dir):
    """Missing rate of every feature before and after preparation."""
    c = _cleaned_ckpt(spark, sf_dir)
    return P.missing_before_after(c, _imputed(c)[0])


@register("gbt_score")
def q_gbt_score(spark, sf_dir):
    """M10 + M13 + P27-P29: boosted trees trained on the prepared training
    split, test split scored (no oracle: a trained model)."""
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    pred = PL.test_predictions(t)
    return SC.score_outputs(pred, F.col("p"), status=F.lit("success"))


@register("model_metrics")
def q_model_metrics(spark, sf_dir):
    """E1-E4 on the boosted-tree test predictions (no oracle)."""
    from . import pipeline as PL
    pred = PL.test_predictions(PL.train(spark, sf_dir))
    table = EV.roc_table(pred)  # scores the split once, for both
    ks = EV.ks_statistic(pred, table=table).first()["ks"]  # one number
    return EV.roc_auc(pred, table=table).withColumn("ks", F.lit(ks))


@register("blend")
def q_blend(spark, sf_dir):
    """M11 + M12: 60/40 blend with a random forest, kept only if better on
    validation (no oracle)."""
    from . import pipeline as PL
    return PL.blend_report(spark, sf_dir)


@register("tree_attribution")
def q_tree_attr(spark, sf_dir):
    """M14 + T4 + F6 + P34: per-row path attributions of the boosted trees
    on the test split and the top factors (no oracle)."""
    from ..operators import explain as X
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    att = X.tree_attributions(t.data.filter(F.col("split") == "test"), t.gbt, t.features)
    return X.factors(att, t.features).select(
        "source_id", "base", "margin", (F.col("margin") - F.col("model_margin")).alias("additivity_error"),
        "positive_factors", "negative_factors")


@register("feature_importance")
def q_importance(spark, sf_dir):
    """A25 + T5: mean |attribution| per feature, top 25 (no oracle)."""
    from ..operators import explain as X
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    att = X.tree_attributions(t.data.filter(F.col("split") == "test"), t.gbt, t.features)
    return X.mean_abs_attribution(att, t.features).orderBy(F.desc("mean_abs_attribution"), "feature").limit(25)


@register("linear_attribution")
def q_linear_attr(spark, sf_dir):
    """M14 (linear model): coefficient x (value - mean) per feature."""
    from ..operators import explain as X
    from ..operators import model as M
    from ..session import compiled_methods
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    tr = t.data.filter(F.col("split") == "train")
    with compiled_methods(spark):
        lm = M.linear_pipeline(t.features).fit(tr)
        means = tr.agg(*[F.avg(f).alias(f) for f in t.features]).first().asDict()
    att = X.linear_attributions(t.data.filter(F.col("split") == "test"), lm, t.features, means)
    return X.factors(att, t.features).select("source_id", "base", "margin", "positive_factors", "negative_factors")


@register("stream_score")
def q_stream(spark, sf_dir):
    """ST1: requests dropped as files, scored by a Structured Streaming query
    (availableNow) into a parquet sink; returns the sink (no oracle)."""
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    from ..streaming.scorer import start_stream
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    src, sink, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    req = _requests(spark, sf_dir)
    req.write.mode("overwrite").parquet(src)
    q = start_stream(spark, src, req.schema, sink, ck)
    q.awaitTermination()
    return spark.read.parquet(sink).select(
        "request_id", "p", "credit_score", "score_band", "default_probability_pct", "recommendation",
        "status", "improvement_tips")


def _drops(req):
    """What is dropped as files: all requests, a third of them sent again, and all replayed. Each is dealt by
    a shuffle: coalesce would run the join and the aggregate of all requests in as few tasks."""
    return [req.repartition(4, "request_id"), req.filter(F.col("request_id") % 3 == 0).repartition(2, "request_id"), req.repartition(2, "request_id")]


def _replayed_stream(spark, sf_dir, scorer=None):
    """Requests dropped as files, some of them twice, scored once each; the sink and its base folder."""
    import os

    from ..streaming.scorer import request_stream, start_deduplicated
    base = _scratch(spark, "stream")
    src, sink, ck = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    req = _requests(spark, sf_dir).withColumn("submitted_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_id") % 600))
    for part in _drops(req):
        part.write.mode("append").parquet(src)
    start_deduplicated(request_stream(spark, src, req.schema, max_files_per_trigger=3), sink, ck, scorer=scorer).awaitTermination()
    return sink, base


_STREAM_COLUMNS = ["request_id", "p", "credit_score", "score_band", "default_probability_pct", "recommendation", "status", "improvement_tips"]


@register("stream_score_once")
def q_stream_once(spark, sf_dir):
    """ST1: replayed request files change nothing; equals the batch."""
    sink, _ = _replayed_stream(spark, sf_dir)
    return spark.read.parquet(sink).select(*_STREAM_COLUMNS)


@register("stream_summary")
def q_stream_summary(spark, sf_dir):
    """ST1 + A22: the batch summary as a running aggregate over the scored
    stream; after the last micro-batch it equals the batch's."""
    import os

    from ..streaming.scorer import latest_summary, start_summary
    sink, base = _replayed_stream(spark, sf_dir)
    out = os.path.join(base, "summary")
    start_summary(spark, sink, out, os.path.join(base, "summary-ckpt")).awaitTermination()
    return latest_summary(spark, out)


@register("stream_score_trained")
def q_stream_trained(spark, sf_dir):
    """ST1 + M13: the boosted trees and their preparation on the stream (no
    oracle: a trained model)."""
    from ..operators.serve import BoostScorer
    from . import pipeline as PL
    t = PL.boosted(spark, sf_dir)
    sink, _ = _replayed_stream(spark, sf_dir, BoostScorer(t.model, t.prep))
    return spark.read.parquet(sink).select(*_STREAM_COLUMNS)


@register("request_score")
def q_request_score(spark, sf_dir):
    """M13 + K6 + K7: the trained model and its preparation, saved, loaded and
    applied to the request batch (no oracle: a trained model)."""
    from ..operators.serve import RequestScorer
    from ..streaming.scorer import score_frame
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    path = _scratch(spark, "request-model")
    RequestScorer(t.gbt, t.prep, t.features).save(path)
    return score_frame(_requests(spark, sf_dir), RequestScorer.load(path)).select(
        "request_id", "p", "credit_score", "score_band", "default_probability_pct", "recommendation", "status")


@register("request_factors")
def q_request_factors(spark, sf_dir):
    """M14 + T4 + F6 on requests: factors of the trained model per request, and
    the distance of the attributions' sum from the model's own margin."""
    from ..operators.serve import RequestScorer
    from . import pipeline as PL
    t = PL.train(spark, sf_dir)
    got = RequestScorer(t.gbt, t.prep, t.features).factors(_requests(spark, sf_dir))
    return got.select("request_id", "base", "margin", (F.col("margin") - F.col("model_margin")).alias("additivity_error"),
                      "positive_factors", "negative_factors")


# ---------------------------------------------------------------- sources
def _scratch(spark, name):
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@register("source_audit")
def q_audit(spark, sf_dir):
    """Rows and columns of every driver table (plus missing columns)."""
    import os

    from ..sources import readers as RD
    names = ["customer", "orders", "lineitem", "events", "part", "supplier", "nation", "region"]
    return RD.audit(spark, {n: os.path.join(sf_dir, f"{n}.parquet") for n in names}).drop("missing_columns", "n_bytes")


@register("lc_features_csv")
def q_lc_csv(spark, sf_dir):
    """S1 + S4 + N12: the peer-lending source written as CSV, read back with
    the typed CSV reader (missing-value tokens, tolerant column subset),
    then the lending builder; equals ``lc_features``."""
    from ..sources import driver_roles as DR
    from ..sources import readers as RD
    path = _scratch(spark, "lc-csv")
    DR.lending(spark, sf_dir).drop("mort_acc").write.option("header", True).csv(path)
    loans = RD.read_source(spark, "lc", path)
    from ..operators import features as FE
    return FE.lending_features(loans)


@register("batch_score_csv")
def q_batch_csv(spark, sf_dir):
    """S6 + S7 + P25 + M15 + K4: requests uploaded as a CSV with messy
    headers, read as text, coerced per field, scored; equals
    ``score_from_prob``."""
    from ..sources import readers as RD
    from ..streaming.scorer import score_frame
    path = _scratch(spark, "batch-csv")
    req = _requests(spark, sf_dir)
    req.toDF(*[c if c == "request_id" else f" {c.replace('_', ' ').title()} " for c in req.columns]) \
        .write.option("header", True).csv(path)
    up = RD.read_request_batch(spark, path)
    out = score_frame(up)
    return out.select(F.col("request_id").cast("long").alias("request_id"), "p", "credit_score", "score_band",
                      "default_probability_pct", "recommendation", "status")


def _broken_batch(spark, sf_dir):
    """The request batch as CSV lines, of which some have too few or too many
    fields, an open quote, or an income that is no number; read and scored.
    Returns (scored rows, rejected lines)."""
    from ..sources import readers as RD
    from ..streaming.scorer import score_frame
    path = _scratch(spark, "broken-csv")
    req = _requests(spark, sf_dir)
    k = F.col("request_id") % 50
    income = F.when(k == 2, F.lit("unknown")).otherwise(F.col("annual_income").cast("string"))
    text = [F.coalesce(income if c == "annual_income" else F.col(c).cast("string"), F.lit("")) for c in req.columns]
    line = F.concat_ws(",", *text)
    line = (F.when(k == 0, F.concat_ws(",", *text[:5])).when(k == 1, F.concat(line, F.lit(",one,two")))
            .when(k == 3, F.concat(F.col("request_id").cast("string"), F.lit(',"'), line)).otherwise(line))
    # one column under the whole header's name: lines are written as they are
    (req.select(line.alias(",".join(req.columns))).write.option("header", True).option("sep", "\u0001").option("quote", "")
     .option("escape", "").csv(path))
    rows, rejects = RD.read_request_batch_with_rejects(spark, path)
    return score_frame(rows), rejects


@register("batch_score_rejects")
def q_batch_rejects(spark, sf_dir):
    """S6 + M15: a batch with broken lines: each request scored, failed (an
    income that is no number) or rejected with its line."""
    scored, rejects = _broken_batch(spark, sf_dir)
    ok = F.col("status") == "success"
    rows = scored.select(F.col("request_id").cast("long").alias("request_id"), F.when(ok, F.col("p")).alias("p"), "credit_score", "score_band",
                         "default_probability_pct", "recommendation", F.when(ok, "success").otherwise("error").alias("status"))
    lost = rejects.select(F.regexp_extract("line", r"(\d+)", 1).cast("long").alias("request_id"), F.lit("rejected").alias("status"))
    return rows.unionByName(lost, allowMissingColumns=True)


@register("batch_summary_rejects")
def q_summary_rejects(spark, sf_dir):
    """A22 + U3 + M15: the summary of a batch of which some rows fail."""
    scored, _ = _broken_batch(spark, sf_dir)
    return SC.batch_summary(scored)


@register("scored_batch_file")
def q_scored_file(spark, sf_dir):
    """K4 + U3: the scored batch file, written with its summary row and read back as text."""
    from ..sources import sinks as SK
    path = _scratch(spark, "scored-file")
    scored, _ = _broken_batch(spark, sf_dir)
    cols = ["request_id", "credit_score", "score_band", "default_probability_pct", "recommendation", "status"]
    SK.write_scored_batch(scored.select(*cols[:-1], F.when(F.col("status") == "success", "success").otherwise("error").alias("status")), path)
    return spark.read.option("header", True).csv(path).select(*cols)


@register("published_table")
def q_published(spark, sf_dir):
    """K1 + S5: the unified table published as a checked version, twice, and read back."""
    from ..sources import sinks as SK
    root = _scratch(spark, "published")
    u = _u(spark, sf_dir)
    SK.publish(u.filter(F.col("TARGET") == 0), root)
    SK.publish(u, root)
    return SK.read_published(spark, root).select(*u.columns)


@register("percent_fields")
def q_percent(spark, sf_dir):
    """Request fields entered in percent, as fractions."""
    req = _requests(spark, sf_dir)
    entered = req.withColumns({f: F.col(f) * 100 for f in SC.PERCENT_FIELDS})
    return SC.percent_to_fraction(entered).select("request_id", *SC.PERCENT_FIELDS)


@register("feature_list_file")
def q_feature_list(spark, sf_dir):
    """K2: the selected-feature list, written as a table and as names, and read back."""
    import os

    from ..sources import sinks as SK
    path = _scratch(spark, "features")
    from ..session import cut_lineage
    SK.write_feature_list(cut_lineage(PR.select_features(_imputed(_cleaned_ckpt(spark, sf_dir))[0]), "selected"), path)
    names = spark.read.text(os.path.join(path, "names")).select(F.col("value").alias("feature"))
    return spark.read.parquet(os.path.join(path, "table")).join(names, "feature").select("rank", "feature", "forced")


@register("eda_report")
def q_report_lines(spark, sf_dir):
    """K3: the profile summary report as text lines (no oracle)."""
    from ..sources import sinks as SK
    return SK.report_lines(_u(spark, sf_dir))


@register("eda_report_full")
def q_report_full(spark, sf_dir):
    """K3 + F4: the whole summary report, line by line."""
    from ..session import cut_lineage
    from ..sources import sinks as SK
    return SK.full_report(cut_lineage(_u(spark, sf_dir), "report-input"))


@register("alternative_signals")
def q_signals(spark, sf_dir):
    """A10 + F4: guarded default rates of the alternative signals."""
    return P.alternative_signals(_u(spark, sf_dir))


@register("ext_score_histogram")
def q_ext_histogram(spark, sf_dir):
    """A17 + F4: external score by class in 40 bins, uncapped."""
    return P.class_histogram(_u(spark, sf_dir), ["ext_source_mean"], bins=40, cap=False)


@register("scaling_histograms")
def q_scaling_histograms(spark, sf_dir):
    """A17 + F4: 40-bin counts before (clipped to the 1st and 99th percentiles) and
    after scaling, of the first three features with more than 1000 values."""
    from ..functions import catalog as K
    from ..session import cut_lineage
    c = _cleaned_ckpt(spark, sf_dir)
    after = cut_lineage(PR.fit_prep(c).transform(c), "scaled")
    feats = [f for f in K.ALL_FEATURES if f in after.columns]
    known = c.agg(*[F.count(f).alias(f) for f in feats]).first()  # a number a feature
    feats = [f for f in feats if known[f] > 1000][:3]
    ends = {r["feature"]: r for r in P.quantiles(c, feats, probs=(0.01, 0.99), materialize=False).collect()} if feats else {}
    before = c.select(*[F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), F.lit(ends[f]["q01"])), F.lit(ends[f]["q99"]))).alias(f) for f in feats])
    return P.histogram(before, feats).withColumn("stage", F.lit("before")).unionByName(P.histogram(after, feats).withColumn("stage", F.lit("after")))


def oracles() -> dict[str, str]:
    from .oracle_prep import prep_oracles, profile_oracles
    from .oracle_score import score_oracles
    out = {}
    out.update(profile_oracles())
    out.update(prep_oracles())
    out.update(score_oracles())
    out.update(model_oracles())
    out.update(source_oracles(out))
    out.update(prep_extra_oracles())
    out.update(rules_oracle())
    out.update(report_oracles(out))
    return out


def rules_oracle() -> dict[str, str]:
    from .oracle_score import n
    from .roles_sql import with_roles
    parts = []
    for f, lo, hi in SC.INPUT_RANGES:
        conds = ([f"{n(f)} < {lo}"] if lo is not None else []) + ([f"{n(f)} > {hi}"] if hi is not None else [])
        parts.append(f"CASE WHEN {' OR '.join(conds)} THEN '{SC.rule_name(f, lo, hi)}' END")
    for f, allowed in SC.INPUT_SETS:
        parts.append(f"CASE WHEN {n(f)} NOT IN ({', '.join(str(float(a)) for a in allowed)}) "
                     f"THEN '{f} not in {{{', '.join(str(a) for a in allowed)}}}' END")
    return {"request_rules": with_roles("score_requests") +
            f"SELECT request_id, list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL) AS violations "
            "FROM score_requests"}


def prep_extra_oracles() -> dict[str, str]:
    from ..functions import catalog as K
    from .oracle_features import round_sql
    from .oracle_prep import _prep_ctes
    feats = list(K.ALL_FEATURES)
    after = "ma AS (SELECT " + ", ".join(f"avg(CAST({f} IS NULL AS DOUBLE)) AS a_{f}" for f in feats) + " FROM imp)"
    rows = "\nUNION ALL\n".join(f"SELECT '{f}' AS feature, mr_{f} AS missing_before, a_{f} AS missing_after FROM st, ma"
                                 for f in feats)
    return {"dedup_with_copies": round_sql(_copies_sql() + "SELECT * FROM cleaned", feats), "prepared_table": _prepared_sql(),
            "missing_before_after": round_sql(_prep_ctes().rstrip("\n") + ",\n" + after + "\n" + rows,
                                              ["missing_before", "missing_after"])}


def source_oracles(existing: dict[str, str]) -> dict[str, str]:
    from .oracle_features import feature_oracles
    names = ["customer", "orders", "lineitem", "events", "part", "supplier", "nation", "region"]
    audit = "\nUNION ALL\n".join(
        f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {n}) AS n_rows, "
        f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {n})) AS n_columns, true AS present" for n in names)
    once = (f"SELECT s.*, t.improvement_tips FROM ({existing['score_from_prob']}) s JOIN ({existing['tips_and_metrics']}) t USING (request_id)")
    ok = "request_id % 50 <> 2"
    out = ["credit_score", "score_band", "default_probability_pct"]
    broken = (f"SELECT request_id, CASE WHEN {ok} THEN p END AS p, {', '.join(f'CASE WHEN {ok} THEN {c} END AS {c}' for c in out)}, "
              f"CASE WHEN {ok} THEN recommendation ELSE 'Error' END AS recommendation, CASE WHEN {ok} THEN 'success' ELSE 'error' END AS status "
              f"FROM ({existing['score_from_prob']}) s WHERE request_id % 50 NOT IN (0, 1, 3)")
    summary = existing["batch_summary"]
    from_scored = summary.rindex("FROM scored")
    summary_broken = (summary[:from_scored] + "FROM (SELECT * REPLACE (CASE WHEN request_id % 50 = 2 THEN 'error' ELSE status END AS status) FROM scored "
                      "WHERE request_id % 50 NOT IN (0, 1, 3)) scored" + summary[from_scored + len("FROM scored"):])
    text = (f"SELECT CAST(request_id AS VARCHAR) AS request_id, CAST(credit_score AS VARCHAR) AS credit_score, score_band, "
            f"CAST(default_probability_pct AS VARCHAR) AS default_probability_pct, recommendation, status FROM ({broken}) b "
            f"UNION ALL SELECT NULL, summary_line, summary_score, summary_probability, summary_recommendations, NULL FROM ({summary_broken}) m")
    fields = ["cc_utilization", "late_payment_rate", "approval_rate", "docs_rate"]
    from .oracle_features import round_sql
    from .roles_sql import with_roles
    return {"stream_score_once": once, "stream_summary": summary, "batch_summary_rejects": summary_broken, "scored_batch_file": text,
            "batch_score_rejects": broken + " UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, NULL, 'rejected' FROM "
                                            f"({existing['score_from_prob']}) s WHERE request_id % 50 IN (0, 1, 3)",
            "published_table": feature_oracles()["unify_sources"],
            "feature_list_file": f"SELECT rank, feature, forced FROM ({existing['select_topk']}) s",
            "percent_fields": round_sql(with_roles("score_requests") + f"SELECT request_id, {', '.join(fields)} FROM score_requests", fields),
            "source_audit": audit, "lc_features_csv": feature_oracles()["lc_features"],
            "batch_score_csv": existing["score_from_prob"],
            "stream_score": f"SELECT s.*, t.improvement_tips FROM ({existing['score_from_prob']}) s "
                            f"JOIN ({existing['tips_and_metrics']}) t USING (request_id)"}


def model_oracles() -> dict[str, str]:
    from ..functions import catalog as K
    from .oracle_features import round_sql, unified_sql
    exprs = []
    for name, kind, a, b in K.INTERACTIONS:
        e = {"mul": f"{a} * {b}",
             "div": f"{a} / (CASE WHEN {b} <> 0 THEN {b} END + 1e-6)",
             "sub": f"{a} - {b}",
             "scaled_mul": f"{a} * {b} / 100",
             "ratio1": f"CASE WHEN {b} + 1 = 0 THEN NULL ELSE {a} / ({b} + 1) END"}[kind]
        exprs.append(f"CAST({e} AS DOUBLE) AS {name}")
    u = f"WITH u AS ({unified_sql()})\n"
    bucket = f"CAST(('0x' || substr(md5(CAST(source_id AS VARCHAR) || '{K.RANDOM_STATE}'), 1, 8)) AS BIGINT) % 100"
    return {
        "split_stratified": u + _stratified_sql("u") + "SELECT source_id, TARGET, split FROM st",
        "boost_root_gains": _root_gains_sql(),
        "shapley_additivity": _prep_head() + ",\n" + _stratified_sql("cleaned", "") +
                              "SELECT TARGET, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_off FROM st WHERE split = 'test' GROUP BY TARGET",
        "interactions": round_sql(u + "SELECT source_id, " + ", ".join(exprs) + " FROM u",
                                  [n for n, *_ in K.INTERACTIONS]),
        "split_assign": u + f"SELECT source_id, TARGET, CASE WHEN {bucket} < 70 THEN 'train' WHEN {bucket} < 85 "
                            "THEN 'validation' ELSE 'test' END AS split FROM u",
    }


def _prep_head() -> str:
    """The CTEs up to ``cleaned``."""
    from .oracle_prep import _prep_ctes
    return _prep_ctes().split(",\nbw AS")[0]


def _stratified_sql(table: str, before: str = ", ") -> str:
    """CTE ``st``: the rows of ``table`` with their stratified split."""
    from ..functions import catalog as K
    key = f"CAST(('0x' || substr(md5(CAST(source_id AS VARCHAR) || '{K.RANDOM_STATE}'), 1, 15)) AS BIGINT)"
    return (f"{before}st AS (SELECT *, CASE WHEN rn <= (n * 70 + 50) // 100 THEN 'train' WHEN rn <= (n * 85 + 50) // 100 THEN 'validation' "
            f"ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY TARGET ORDER BY {key}) AS rn, "
            f"count(*) OVER (PARTITION BY TARGET) AS n FROM {table}) s)\n")


def _root_gains_sql() -> str:
    """Every feature's best first split, by trying all its edges and both sides of the missing values."""
    from ..functions import catalog as K
    from .oracle_features import round_sql
    feats = list(K.ALL_FEATURES)
    bins, l1, l2, rows = 64, 0.1, 0.1, 50
    probs = ", ".join(repr(i / bins) for i in range(1, bins))
    worth = lambda g, h: f"(greatest(abs({g}) - {l1}, 0) ** 2 / greatest({h} + {l2}, 1e-16))"
    edges = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, list_sort(list_distinct(list_filter(quantile_cont({f}, [{probs}]), lambda x: x < mx))) AS e "
        f"FROM cleaned, (SELECT max({f}) AS mx FROM cleaned) m GROUP BY mx HAVING count({f}) > 0" for f in feats)
    sql = (_prep_head() + f""",
gh AS (SELECT c.*, q - TARGET AS g, q * (1 - q) AS h FROM cleaned c, (SELECT avg(TARGET) AS q FROM cleaned) a),
w AS (SELECT g, h, {', '.join(feats)} FROM gh),
lf AS (SELECT g, h, feature, value FROM w UNPIVOT INCLUDE NULLS (value FOR feature IN ({', '.join(feats)}))),
ed AS ({edges}),
cuts AS (SELECT feature, e, unnest(range(0, len(e) + 1)) AS k FROM ed),
b AS (SELECT lf.feature, CASE WHEN value IS NOT NULL THEN len(list_filter(ed.e, lambda x: x < value)) END AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n
    FROM lf JOIN ed USING (feature) GROUP BY ALL),
tot AS (SELECT feature, sum(g) AS g, sum(h) AS h, sum(n) AS n, coalesce(sum(g) FILTER (WHERE bin IS NULL), 0) AS mg,
    coalesce(sum(h) FILTER (WHERE bin IS NULL), 0) AS mh, coalesce(sum(n) FILTER (WHERE bin IS NULL), 0) AS mn FROM b GROUP BY feature),
known AS (SELECT c.feature, c.k, coalesce(sum(b.g), 0) AS g, coalesce(sum(b.h), 0) AS h, coalesce(sum(b.n), 0) AS n
    FROM cuts c LEFT JOIN b ON b.feature = c.feature AND b.bin <= c.k GROUP BY c.feature, c.k),
sides AS (SELECT k.feature, k.g + s * t.mg AS lg, k.h + s * t.mh AS lh, k.n + s * t.mn AS ln, t.g AS g, t.h AS h, t.n AS n
    FROM known k JOIN tot t USING (feature), (VALUES (0), (1)) v(s)),
best AS (SELECT feature, max({worth('lg', 'lh')} + {worth('g - lg', 'h - lh')} - {worth('g', 'h')}) AS gain
    FROM sides WHERE ln >= {rows} AND n - ln >= {rows} AND lh > 1e-3 AND h - lh > 1e-3 GROUP BY feature)
SELECT t.feature, CAST(coalesce(len(ed.e), 0) AS INTEGER) AS n_cuts, CAST(t.mn AS BIGINT) AS n_missing, best.gain AS best_gain
FROM (SELECT feature, count(*) - count(value) AS mn FROM lf GROUP BY feature) t LEFT JOIN ed USING (feature) LEFT JOIN best USING (feature)""")
    return round_sql(sql, ["best_gain"])


def _copies_sql() -> str:
    """The CTEs up to ``cleaned`` over the rows of ``sources.unified_with_copies``."""
    from ..functions import catalog as K
    n = "TRY_CAST(split_part(source_id, '_', 1) AS BIGINT)"
    suffix = "substr(source_id, instr(source_id, '_'))"
    u = (f"u AS (SELECT * FROM u0 UNION ALL BY NAME SELECT * REPLACE (CAST({n} + 10000000 AS VARCHAR) || {suffix} AS source_id, "
         f"CASE WHEN {n} % 4 <> 0 THEN 1 - TARGET END AS TARGET) FROM u0 WHERE {n} IS NOT NULL UNION ALL BY NAME "
         f"SELECT * REPLACE (CAST({n} + 20000000 AS VARCHAR) || {suffix} AS source_id, '{K.SOURCE_ORDER[0]}' AS source_dataset) "
         f"FROM u0 WHERE {n} % 3 = 0)")
    return _prep_head().replace("WITH u AS (", "WITH u0 AS (", 1).replace(",\ncleaned AS (", f",\n{u},\ncleaned AS (", 1) + "\n"


def _prepared_sql() -> str:
    from ..functions import catalog as K
    from .oracle_features import round_sql
    from .oracle_prep import _fscore_sql, _prep_ctes, _selected_sql
    feats = list(K.ALL_FEATURES)
    fits = ", ".join(f"quantile_cont({f}, 0.5) AS c_{f}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS s_{f}" for f in feats)
    picks = ", ".join(f"bool_or(feature = '{f}') AS p_{f}" for f in feats)
    cols = ", ".join(f"CAST(CASE WHEN p_{f} THEN ({f} - c_{f}) / (CASE WHEN s_{f} = 0 THEN 1 ELSE s_{f} END) END AS DOUBLE) AS {f}" for f in feats)
    inter = []
    for name, kind, a, b in K.INTERACTIONS:
        e = {"mul": f"{a} * {b}", "div": f"{a} / (CASE WHEN {b} <> 0 THEN {b} END + 1e-6)", "sub": f"{a} - {b}", "scaled_mul": f"{a} * {b} / 100",
             "ratio1": f"CASE WHEN {b} + 1 = 0 THEN NULL ELSE {a} / ({b} + 1) END"}[kind]
        inter.append(f"CAST({e} AS DOUBLE) AS {name}")
    return round_sql(
        _prep_ctes().rstrip("\n") + f",\nfs AS ({_fscore_sql()}),\nsel AS ({_selected_sql()}),\nfit AS (SELECT {fits} FROM imp),\n"
        f"pick AS (SELECT {picks} FROM sel),\nprep AS (SELECT source_id, TARGET, source_dataset, {cols} FROM imp, fit, pick)\n"
        f"SELECT *, {', '.join(inter)} FROM prep", [*feats, *[n for n, *_ in K.INTERACTIONS]])


def report_oracles(existing: dict[str, str]) -> dict[str, str]:
    from ..functions import catalog as K
    from .oracle_features import round_sql, unified_sql
    feats = list(K.ALL_FEATURES)
    pct = lambda x, n: f"printf('%.{n}f%%', {x} * 100)"
    key = ["age_years", "credit_to_income", "inst_late_payment_rate", "ext_source_mean"]
    rates = " UNION ALL ".join(f"SELECT {i} AS o, '{f}' AS feature, mr_{f} AS r FROM mr" for i, f in enumerate(feats))
    sources = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(K.SOURCE_ORDER))
    heads = ["[1] DATASET OVERVIEW", "[2] CLASS IMBALANCE", "[3] NEW USER ANALYSIS", "[4] TOP 15 MOST MISSING FEATURES", "[5] FEATURES WITH 0% MISSING (COMPLETE)",
             "[6] KEY STATISTICS"]
    lines = [(0, 0, f"SELECT '{'=' * 60}' AS t"), (0, 1, "SELECT 'ALTERNATIVE CREDIT SCORING — EDA SUMMARY REPORT' AS t"), (0, 2, f"SELECT '{'=' * 60}' AS t")]
    for i, h in enumerate(heads, 1):
        lines += [(i, 0, "SELECT '' AS t"), (i, 1, f"SELECT '{h}' AS t")]
    parts = [f"SELECT {s} AS s, {k} AS k, t FROM ({q}) x" for s, k, q in lines]
    parts.append(f"SELECT 1, 2 + (CASE source_dataset {sources} END), printf('  %-30s %s rows  default=%s', source_dataset, lpad(printf('%,d', count(*)), 8, ' '), "
                 f"{pct('avg(TARGET)', 2)}) FROM u GROUP BY source_dataset")
    parts.append("SELECT 1, 90, ''")
    parts.append(f"SELECT 1, 91, printf('  TOTAL: %,d rows | Default rate: %s', count(*), {pct('avg(TARGET)', 2)}) FROM u")
    parts.append(f"SELECT 1, 92, '  Features available: {len(feats)}/80'")
    for k, (label, v) in enumerate((("No Default: ", 0), ("Default:    ", 1)), 2):
        parts.append(f"SELECT 2, {k}, printf('  {label}%,d (%s)', count(*) FILTER (WHERE TARGET = {v}), {pct(f'count(*) FILTER (WHERE TARGET = {v}) / count(*)', 1)}) FROM u")
    parts.append("SELECT 2, 4, printf('  Imbalance ratio: %.1f:1', count(*) FILTER (WHERE TARGET = 0) / count(*) FILTER (WHERE TARGET = 1)) FROM u")
    new = "count(*) FILTER (WHERE has_loan_history = 0)"
    parts.append(f"SELECT 3, 2, printf('  New users (no loan history): %,d (%s)', {new}, {pct(f'{new} / count(*)', 1)}) FROM u")
    for k, (label, v) in enumerate((("New user", 0), ("Existing user", 1)), 3):
        parts.append(f"SELECT 3, {k}, '  {label} default rate: ' || {pct(f'avg(TARGET) FILTER (WHERE has_loan_history = {v})', 2)} FROM u HAVING {new} > 0")
    parts.append(f"SELECT 4, 1 + row_number() OVER (ORDER BY r DESC, o), printf('  %-45s %s  %s', feature, lpad({pct('r', 1)}, 6, ' '), "
                 "repeat('█', CAST(floor(r * 20) AS INTEGER))) FROM rt QUALIFY row_number() OVER (ORDER BY r DESC, o) <= 15")
    parts.append("SELECT 5, 2 + o, '   ' || feature FROM rt WHERE r = 0")
    for i, f in enumerate(key):
        parts += [f"SELECT 6, {2 + 3 * i}, '' FROM u HAVING count({f}) > 10", f"SELECT 6, {3 + 3 * i}, '  {f}:' FROM u HAVING count({f}) > 10",
                  f"SELECT 6, {4 + 3 * i}, printf('    mean=%.3f | median=%.3f | std=%.3f | missing=%s', avg({f}), quantile_cont({f}, 0.5), stddev_samp({f}), "
                  f"{pct(f'avg(CAST({f} IS NULL AS DOUBLE))', 1)}) FROM u HAVING count({f}) > 10"]
    mr = ", ".join(f"avg(CAST({f} IS NULL AS DOUBLE)) AS mr_{f}" for f in feats)
    report = (f"WITH u AS ({unified_sql()}),\nmr AS (SELECT {mr} FROM u),\nrt AS ({rates}),\nall_lines AS ({' UNION ALL '.join(parts)})\n"
              "SELECT CAST(row_number() OVER (ORDER BY s, k) AS INTEGER) AS line_no, t AS text FROM all_lines")
    signals = ["has_savings", "checking_account_ordinal", "employment_stability"]
    guards = " OR ".join(f"(dimension = '{f}' AND (SELECT count({f}) FROM u2) > 100)" for f in signals)
    u2 = f"WITH u2 AS ({unified_sql()})\n"
    hist = (u2 + """, x AS (SELECT TARGET, ext_source_mean AS v FROM u2 WHERE ext_source_mean IS NOT NULL AND TARGET IS NOT NULL AND (SELECT count(ext_source_mean) FROM u2) > 100),
r0 AS (SELECT TARGET, min(v) AS a, max(v) AS b, count(*) AS n FROM x GROUP BY TARGET),
r AS (SELECT TARGET, n, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM r0),
b AS (SELECT x.TARGET, CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, lo, hi, n FROM x JOIN r USING (TARGET))
SELECT 'ext_source_mean' AS feature, TARGET, bin, lo + bin * ((hi - lo) / 40) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 40) AS bin_hi, count(*) AS count,
    count(*) / (n * ((hi - lo) / 40)) AS density FROM b GROUP BY TARGET, bin, lo, hi, n""")
    return {"eda_report_full": report,
            "alternative_signals": u2 + f"SELECT * FROM ({existing['default_rate_by_key']}) d WHERE dimension = 'late_bucket' OR {guards}",
            "ext_score_histogram": round_sql(hist, ["bin_lo", "bin_hi", "density"]),
            "scaling_histograms": _scaling_sql()}


def _scaling_sql() -> str:
    from ..functions import catalog as K
    from .oracle_features import round_sql
    prepared = _prepared_sql()
    head, body = prepared.split("WITH u AS (", 1)
    # the CTEs of the prepared table, without the rounding around its last SELECT
    ctes = "WITH u AS (" + body[:body.rindex("SELECT *, ")]
    feats = list(K.ALL_FEATURES)
    rows = []
    for stage in ("before", "after"):
        for f in feats:
            table = "prep" if stage == "after" else f"(SELECT CASE WHEN {f} IS NOT NULL THEN least(greatest({f}, lo_{f}), hi_{f}) END AS {f} FROM cleaned, bw) y"
            rows.append(f"SELECT '{stage}' AS stage, '{f}' AS feature, k AS bin, lo + k * w AS bin_lo, lo + (k + 1) * w AS bin_hi, "
                        f"(SELECT count(*) FROM {table} WHERE CAST(least(floor(({f} - lo) / w), 39) AS INTEGER) = k) AS count FROM "
                        f"(SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, (CASE WHEN a = b THEN 1.0 ELSE b - a END) / 40 AS w FROM "
                        f"(SELECT min({f}) AS a, max({f}) AS b FROM {table}) e) r, (SELECT CAST(unnest(range(0, 40)) AS INTEGER) AS k) ks "
                        f"WHERE lo IS NOT NULL AND '{f}' IN (SELECT feature FROM three)")
    ords = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(feats))
    many = " OR ".join(f"(feature = '{f}' AND (SELECT count({f}) FROM cleaned) > 1000)" for f in feats)
    three = f"three AS (SELECT feature FROM sel WHERE {many} ORDER BY CASE feature {ords} END LIMIT 3)"
    return round_sql(ctes.rstrip() + f",\n{three}\n" + "\nUNION ALL\n".join(rows), ["bin_lo", "bin_hi"])
