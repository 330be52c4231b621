"""End-to-end batch pipeline: unify -> clean -> split -> fit preparation on
the training split -> transform -> interactions -> train -> evaluate.

The cleaned, split table is checkpointed once into the shared checkpoint
folder: several fits read it, and a lost executor then recomputes from
the checkpoint instead of from the raw sources.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..operators import boost as B
from ..operators import evaluate as EV
from ..operators import model as M
from ..operators import prep as PR
from ..session import compiled_methods, cut_lineage
from . import sources as S


@dataclass
class Trained:
    prep: PR.PrepModel
    features: list[str]
    data: DataFrame                      # prepared rows with split, weight, is_val
    gbt: PipelineModel
    spw: float
    extra: dict = field(default_factory=dict)


_CACHE: dict[tuple, Trained | Boosted] = {}


def prepared(spark: SparkSession, sf_dir: str, fit_on: str = "train", fill: bool = True, stratified: bool = False) -> tuple[DataFrame, PR.PrepModel]:
    """Cleaned + split + prepared (+ interactions) table and its fitted prep.
    ``fit_on='train'`` fits preparation on the training split only;
    ``'all'`` fits on every row (as the source pipeline does). ``stratified``
    splits exactly within each class. Without ``fill`` undefined
    interactions stay NULL."""
    # the cleaned rows are read from files; the split is a hash of the id, computed again in each pass
    c = PR.clean(S.unified(spark, sf_dir), written=True)
    c = M.assign_stratified(c) if stratified else M.assign_split(c)
    fit_df = c.filter(F.col("split") == "train") if fit_on == "train" else c
    pm = PR.fit_prep(fit_df)
    order = {r["feature"]: r for r in pm.scales}
    x = PR.apply_impute(PR.apply_winsor(c, pm.bounds), pm.fills)
    x = PR.apply_scale(x, [order[f] for f in pm.selected], keep=K.META_COLUMNS + ["split"])
    x = M.add_interactions(x)
    # Spark's tree learners take no missing values (no learned missing
    # direction); an undefined interaction (zero denominator) becomes 0.
    inter = list(M.interaction_columns(x.columns))
    return (x.fillna(0.0, subset=inter) if inter and fill else x), pm


def train(spark: SparkSession, sf_dir: str, params: M.TrainParams | None = None,
          fit_on: str = "train") -> Trained:
    key = (spark.sparkContext.applicationId, sf_dir, fit_on, repr(params))
    if key in _CACHE:
        return _CACHE[key]
    with compiled_methods(spark):
        x, pm = prepared(spark, sf_dir, fit_on)
        feats = pm.selected + [n for n in M.interaction_columns(x.columns)]
        spw = M.class_weight(x.filter(F.col("split") == "train"))
        data = M.with_weight(x, spw).withColumn("is_val", F.col("split") == "validation")
        data = cut_lineage(data)
        fit_rows = data.filter(F.col("split").isin("train", "validation"))
        gbt = M.gbt_pipeline(feats, params or M.TrainParams()).fit(fit_rows)
    t = Trained(pm, feats, data, gbt, spw)
    _CACHE[key] = t
    return t


@dataclass
class Boosted:
    prep: PR.PrepModel
    features: list[str]
    data: DataFrame                      # prepared rows with split, weight, is_val; undefined values NULL
    spw: float
    model: B.BoostModel | None = None


def boost_data(spark: SparkSession, sf_dir: str) -> Boosted:
    """The model table with an exact stratified split, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, "boost")
    if key not in _CACHE:
        with compiled_methods(spark):
            x, pm = prepared(spark, sf_dir, fill=False, stratified=True)
            spw = M.class_weight(x.filter(F.col("split") == "train"))
            data = cut_lineage(M.with_weight(x, spw).withColumn("is_val", F.col("split") == "validation"), "boost-data")
        _CACHE[key] = Boosted(pm, pm.selected + list(M.interaction_columns(x.columns)), data, spw)
    return _CACHE[key]


def boosted(spark: SparkSession, sf_dir: str) -> Boosted:
    """The default boosted trees (M10) over ``boost_data``."""
    t = boost_data(spark, sf_dir)
    if t.model is None:
        t.model = B.fit(t.data.filter(F.col("split").isin("train", "validation")), t.features)
    return t


def boost_predictions(t: Boosted, model: B.BoostModel | None = None, split: str = "test") -> DataFrame:
    return (model or t.model).scored(t.data.filter(F.col("split") == split), ["source_id", "source_dataset", "TARGET"])


def test_predictions(t: Trained, model: PipelineModel | None = None, split: str = "test") -> DataFrame:
    rows = t.data.filter(F.col("split") == split)
    return M.positive_probability(model or t.gbt, rows).select("source_id", "source_dataset", "TARGET", "p")


def blend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12: boosted trees alone vs a 60/40 blend with a random forest;
    the blend is kept only if it is better on the validation split."""
    t = train(spark, sf_dir)
    fit_rows = t.data.filter(F.col("split") == "train")
    rf = M.forest_pipeline(t.features).fit(fit_rows)
    rows = []
    for split in ("validation", "test"):
        a = test_predictions(t, t.gbt, split)
        b = test_predictions(t, rf, split)
        bl = M.blend(a, b).join(a.select("source_id", "TARGET"), "source_id")
        auc_a = EV.roc_auc(a).first()["auc"]
        auc_b = EV.roc_auc(bl).first()["auc"]
        rows.append((split, auc_a, auc_b))
    keep_blend = rows[0][2] is not None and rows[0][1] is not None and rows[0][2] > rows[0][1]
    out = [(s, "boosted_trees", a, not keep_blend) for s, a, _ in rows] + \
          [(s, "blend_60_40", b, keep_blend) for s, _, b in rows]
    return spark.createDataFrame(out, "split string, model string, auc double, chosen boolean")
