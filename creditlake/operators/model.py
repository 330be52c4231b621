"""Model operators (M6-M13): interaction features, deterministic splits,
boosted-tree training with class weight and early stopping, optional
second learner blend, and batch scoring with a fitted pipeline.

Training uses Spark ML estimators (each boosting iteration is one
distributed pass over the cached training matrix); nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..functions.expr import div
from .profile import radix_select


# --------------------------------------------------------------------- M6
def interaction_columns(columns: list[str]) -> dict[str, Column]:
    """The seven guarded interaction features whose inputs exist.
    Quotients treat a zero denominator as missing and add 1e-6."""
    out = {}
    for name, kind, a, b in K.INTERACTIONS:
        if a not in columns or b not in columns:
            continue
        x, y = F.col(a), F.col(b)
        if kind == "mul":
            e = x * y
        elif kind == "div":
            e = div(x, F.when(y != 0, y) + F.lit(1e-6))
        elif kind == "sub":
            e = x - y
        elif kind == "scaled_mul":
            e = x * y / 100
        else:  # ratio1
            e = div(x, y + 1)
        out[name] = e.cast("double")
    return out


def add_interactions(df: DataFrame) -> DataFrame:
    cols = interaction_columns(df.columns)
    return df.withColumns(cols) if cols else df


# --------------------------------------------------------------------- M8
def split_bucket(id_col: str = "source_id", seed: int = K.RANDOM_STATE) -> Column:
    """Stable 0-99 bucket from the md5 of id || seed (same value in any SQL
    engine with md5); independent of partitioning and of re-execution."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 100).cast("int")


def assign_split(df: DataFrame, train: int = 70, val: int = 15, id_col: str = "source_id",
                 seed: int = K.RANDOM_STATE) -> DataFrame:
    """M8: 70 / 15 / 15 train / validation / test by hash bucket. The hash is
    independent of the label, so each split keeps the class mix in
    expectation without a per-class global ordering."""
    b = split_bucket(id_col, seed)
    b = F.when(F.col(id_col).isNull(), F.raise_error(F.lit(f"{id_col} is NULL: rows need ids before the split"))).otherwise(b)
    return df.withColumn("split", F.when(b < train, "train").when(b < train + val, "validation").otherwise("test"))


def split_key(id_col: str = "source_id", seed: int = K.RANDOM_STATE) -> Column:
    """The first 60 bits of the md5 of id || seed: the order in which rows are dealt."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def assign_stratified(df: DataFrame, train: int = 70, val: int = 15, id_col: str = "source_id", label: str = "TARGET",
                      seed: int = K.RANDOM_STATE) -> DataFrame:
    """M8: an exact split within each class. Of a class of n rows, those with the first
    round(n * train %) keys are training rows, the next up to round(n * (train + val) %) validation
    rows, the rest test rows (halves round up); rows without a label are a class of their own.

    The keys at these ranks are found by radix selection over all classes together and
    serve as thresholds, so no class is ever sorted or gathered. Rows of one id have one
    key and stay together; apart from such rows the shares are exact to one row."""
    if not df.where(F.col(id_col).isNull()).isEmpty():
        raise ValueError(f"{id_col} is NULL: rows need ids before the split")
    key = split_key(id_col, seed)
    classes = {"k0": F.col(label) == 0, "k1": F.col(label) == 1, "kn": F.col(label).isNull()}

    def ends(n: int) -> tuple[int, int]:
        return (n * train + 50) // 100, (n * (train + val) + 50) // 100

    n_of, found = radix_select(df.select(*[F.when(c, key).alias(k) for k, c in classes.items()]), list(classes),
                               lambda n: sorted({e - 1 for e in ends(n) if e}))
    # the last key of each part; a part without rows ends before all keys
    last = {k: [found[k, e - 1] if e else -1 for e in ends(n)] for k, n in n_of.items()}
    split = F.lit("test")
    for k, (a, b) in last.items():
        split = F.when(classes[k], F.when(key <= a, "train").when(key <= b, "validation").otherwise("test")).otherwise(split)
    return df.withColumn("split", split)


# ------------------------------------------------------------- M7 / A23
def class_weight(df: DataFrame, label: str = "TARGET") -> float:
    """#negative / #positive rounded to 2 places (one global aggregate;
    the rounding of ``profile.class_balance``)."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    r = df.agg(F.round(div(neg, pos), 2).alias("w")).first()
    return r["w"] if r["w"] is not None else 1.0


def with_weight(df: DataFrame, spw: float, label: str = "TARGET") -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(spw))).otherwise(F.lit(1.0)))


@dataclass
class TrainParams:
    """Boosting parameters (names follow Spark ML)."""
    max_iter: int = 100
    max_depth: int = 5
    step_size: float = 0.1
    subsampling_rate: float = 0.8
    feature_subset: str = "0.8"
    min_instances_per_node: int = 50
    validation_tol: float = 0.001
    seed: int = K.RANDOM_STATE


def gbt_pipeline(features: list[str], params: TrainParams | None = None,
                 use_validation: bool = True, label: str = "TARGET") -> Pipeline:
    """Assembler + gradient-boosted trees with class weight; when
    ``use_validation`` the rows flagged ``is_val`` drive early stopping."""
    p = params or TrainParams()
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                        maxIter=p.max_iter, maxDepth=p.max_depth, stepSize=p.step_size,
                        subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset,
                        minInstancesPerNode=p.min_instances_per_node, seed=p.seed,
                        validationTol=p.validation_tol,
                        **({"validationIndicatorCol": "is_val"} if use_validation else {}))
    return Pipeline(stages=[asm, gbt])


def forest_pipeline(features: list[str], seed: int = K.RANDOM_STATE, label: str = "TARGET") -> Pipeline:
    """M11 second learner: a random forest on the same matrix and weights."""
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight",
                                numTrees=100, maxDepth=7, seed=seed)
    return Pipeline(stages=[asm, rf])


def linear_pipeline(features: list[str], label: str = "TARGET") -> Pipeline:
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=50, regParam=0.01)
    return Pipeline(stages=[asm, lr])


def positive_probability(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """P(default) column from a fitted pipeline (works on streams too)."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def blend(df_a: DataFrame, df_b: DataFrame, key: str = "source_id",
          weights=K.BLEND_WEIGHTS) -> DataFrame:
    """Fixed-weight blend of two models' probabilities, joined on id
    (both sides are one row per id)."""
    wa, wb = weights
    a = df_a.select(key, F.col("p").alias("p_a"))
    b = df_b.select(key, F.col("p").alias("p_b"))
    return a.join(b, key).withColumn("p", F.lit(wa) * F.col("p_a") + F.lit(wb) * F.col("p_b"))
