"""Preparation operators (M1-M5, U2, A20, T2): fit -> small parameter
DataFrame, apply -> one ``select`` of column expressions.

Fitted state is data: bounds, fill values, F scores and scales are tiny
(one row per catalogue feature) and are collected to the driver only to be
inlined as literals into a single projection; the data itself never
leaves the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import catalog as K
from ..functions.expr import div, round6
from ..session import compiled_methods, cut_lineage
from .features import id_number, source_ordinal
from .profile import around, between, features_of, from_key, missing_rates, missing_rates_of, quantile_frame, quantiles, radix_select


# ------------------------------------------------------------------ M1/U2
def row_keys(rows: DataFrame, features: list[str]) -> DataFrame:
    """(_uid, _k1, _k2): 128 bits of each row's feature vector, two polynomials over
    the values' mixed bits. NULL counts as a value of its own, -0.0 as 0.0.
    (A JVM hash of 84 columns is one method too large to be compiled; a batch of
    columns at a time takes a fraction of that.)"""
    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def run(batches):
        for b in batches:
            keys = [np.zeros(b.num_rows, np.uint64) for _ in range(2)]
            for c in b.columns[1:]:
                v = c.cast(pa.float64())
                bits = (v.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0).view(np.uint64) + np.uint64(1)
                bits[v.is_null().to_numpy(zero_copy_only=False)] = 0
                for k, base in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    keys[k] = mixed(keys[k] * np.uint64(base) + mixed(bits + np.uint64(base)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(k.view(np.int64)) for k in keys)], ["_uid", "_k1", "_k2"])

    return rows.select("_uid", *features).mapInArrow(run, "_uid long, _k1 long, _k2 long")


#: Rows of repeated keys up to which their numbers are joined (8 bytes a row).
FEW_REPEATED = 1_000_000


def dedup_keep_first(df: DataFrame, features: list[str] | None = None, written: bool = False, few: int = FEW_REPEATED) -> DataFrame:
    """One row per distinct feature vector (label not part of the key);
    the first row in (source order, numeric id, id) order wins; ids without
    a number come last in their source.

    Rows are written once and numbered. A count by 128-bit keys of the vectors (16 bytes
    a row to shuffle) tells which may repeat; if none does, the written rows are the result.
    Where at most ``few`` rows have repeated keys, only these are grouped, by their full
    vectors, so vectors whose keys collide stay apart, and losers are removed by row
    number. Where there are more, joins by number would shuffle the wide rows twice and
    grouping once more, so all rows are grouped by their vectors, once, and the first
    row's id, label and source are taken there; the result is written (a negative zero
    comes out as 0). Either is an aggregate (min_by), not a window: it combines before
    the shuffle, so a vector repeated across a third of the table never lands in one
    task whole. ``written``: the result is read from files in any case (losers, where
    there are any, are removed once and not in each later pass)."""
    feats = features or features_of(df)
    key = ["_k1", "_k2"]
    meta = ["source_id", "TARGET", "source_dataset"]
    order = F.struct(source_ordinal().alias("o"), id_number().isNull().alias("n"), id_number().alias("i"), F.col("source_id").alias("s"), F.col("_uid").alias("u"))
    with compiled_methods(df.sparkSession):
        t = cut_lineage(df.withColumn("_uid", F.monotonically_increasing_id()), "dedup-rows")
        keys = row_keys(t, feats)
        repeated = keys.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        n = repeated.agg(F.sum("n")).first()[0] or 0
        if not n:
            return t.select(*meta, *feats)
        if n > few:
            first = t.select(F.struct(*meta).alias("_first"), order.alias("_order"), *feats).groupBy(*feats).agg(F.min_by("_first", "_order").alias("_first"))
            return cut_lineage(first.select("_first.*", *feats), "dedup-kept")
        twice = cut_lineage(keys.join(repeated, key, "left_semi").select("_uid"), "dedup-repeated")
        won = t.join(twice, "_uid", "left_semi").groupBy(*feats).agg(F.min_by("_uid", order).alias("_uid")).select("_uid")
        lost = cut_lineage(twice.join(won, "_uid", "left_anti"), "dedup-losers")
        kept = t.join(lost, "_uid", "left_anti").select(*meta, *feats)
        return cut_lineage(kept, "dedup-kept") if written else kept


def clean(df: DataFrame, written: bool = False) -> DataFrame:
    """M1: drop rows without a label (F2), then duplicates."""
    return dedup_keep_first(df.filter(F.col("TARGET").isNotNull()), written=written)


# -------------------------------------------------------- order statistics
@dataclass
class OrderStats:
    """The order statistics that the whole preparation (M2, M3, M5) asks for, selected together in one
    set of passes over the table before it is clipped and filled.

    Clipping keeps the order, so a clipped column's order statistics are the clipped ones; filling
    puts all missing rows at the median's place, so an order statistic of a filled column is one
    before that place, the fill value, or one that many ranks lower."""
    rows: int
    n_of: dict[str, int]                    # values of each feature (none: not there)
    at: dict[tuple[str, int], float]        # value by feature and rank
    lo: float
    hi: float

    def raw(self, f: str, p: float) -> float:
        n = self.n_of[f]
        return between(n, p, *(self.at[f, r] for r in around(n, p)))

    def clipped_at(self, f: str, rank: int) -> float:
        v, a, b = self.at[f, rank], self.raw(f, self.lo), self.raw(f, self.hi)
        return v if not a < b else a if v < a else b if v > b else v

    def median(self, f: str) -> float:
        """Of the clipped values."""
        n = self.n_of[f]
        return between(n, 0.5, *(self.clipped_at(f, r) for r in around(n, 0.5)))

    def filled(self, f: str, p: float) -> float:
        """The quantile p of the clipped and filled column."""
        if f not in self.n_of:
            return 0.0
        places = [_filled_rank(self.n_of[f], self.rows, r) for r in around(self.rows, p)]
        return between(self.rows, p, *(self.median(f) if r is None else self.clipped_at(f, r) for r in places))


def _filled_rank(n: int, rows: int, rank: int) -> int | None:
    """Of a column with n values whose other rows were filled with the median, where the value at ``rank`` was before (None: filled)."""
    below = around(n, 0.5)[0] + 1   # values that go before the filled ones
    return rank if rank < below else None if rank < below + rows - n else rank - (rows - n)


def order_stats(df: DataFrame, features: list[str] | None = None, lo: float = K.WINSOR_LOW, hi: float = K.WINSOR_HIGH) -> OrderStats | None:
    """Order statistics for winsor bounds (``lo``, ``hi``), medians and the quartiles after filling. None
    where they don't follow from the unclipped rows (no rows; NaN or infinite values, which filling and
    interpolation treat apart): the steps then each select their own."""
    feats = features or features_of(df)
    rows = df.count()
    if not rows:
        return None

    def ranks(n):
        own = {r for p in (lo, hi, 0.5) for r in around(n, p)}
        later = {_filled_rank(n, rows, r) for p in SCALE_PROBS for r in around(rows, p)}
        return sorted((own | later | {0, n - 1}) - {None})

    n_of, found = radix_select(df.select(*[F.col(f).cast("double").alias(f) for f in feats]), feats, ranks)
    at = {k: float(from_key(v)) for k, v in found.items()}
    if not all(np.isfinite(v) for v in at.values()):
        return None
    return OrderStats(rows, n_of, at, lo, hi)


# --------------------------------------------------------------------- M2
def winsor_bounds(df: DataFrame, lo: float = K.WINSOR_LOW, hi: float = K.WINSOR_HIGH,
                  materialize: bool = True, stats: OrderStats | None = None) -> DataFrame:
    """(feature, lo, hi, applied): 1st / 99th percentiles; a feature is
    clipped only when lo < hi. ``stats``: the rows' ``order_stats``."""
    if stats is None:
        q = quantiles(df, features_of(df), probs=(lo, hi), materialize=materialize)
    else:
        feats = features_of(df)
        q = quantile_frame(df.sparkSession, feats, {(f, i): stats.raw(f, p) for f in feats if f in stats.n_of for i, p in enumerate((lo, hi))}, (lo, hi))
    a, b = q.columns[1], q.columns[2]
    return q.select("feature", F.col(a).alias("lo"), F.col(b).alias("hi"),
                    (F.col(a) < F.col(b)).alias("applied"))


def apply_winsor(df: DataFrame, bounds: list[dict]) -> DataFrame:
    by = {r["feature"]: r for r in bounds if r["applied"]}
    cols = []
    for f in df.columns:
        r = by.get(f)
        if r is None:
            cols.append(F.col(f))
        else:
            x = F.col(f)
            cols.append(F.when(x < r["lo"], F.lit(r["lo"])).when(x > r["hi"], F.lit(r["hi"]))
                        .otherwise(x).alias(f))
    return df.select(*cols)


def winsor_report(df: DataFrame, bounds_df: DataFrame) -> DataFrame:
    """M2 outcome per feature: bounds and how many values each side clips."""
    rows = bounds_df.collect()  # <= one row per catalogue feature
    aggs = []
    for r in rows:
        f = r["feature"]
        if r["applied"]:
            aggs += [F.count_if(F.col(f) < r["lo"]).alias(f"l_{f}"), F.count_if(F.col(f) > r["hi"]).alias(f"h_{f}")]
        else:
            aggs += [F.lit(0).cast("long").alias(f"l_{f}"), F.lit(0).cast("long").alias(f"h_{f}")]
    counts = df.agg(*aggs)
    long = counts.select(F.explode(F.array(*[
        F.struct(F.lit(r["feature"]).alias("feature"), F.col(f"l_{r['feature']}").alias("n_clipped_low"),
                 F.col(f"h_{r['feature']}").alias("n_clipped_high")) for r in rows])).alias("s")).select("s.*")
    return bounds_df.join(F.broadcast(long), "feature")


# --------------------------------------------------------------------- M3
def impute_params(df: DataFrame, materialize: bool = True, stats: OrderStats | None = None) -> DataFrame:
    """(feature, missing_rate, status, fill_value): empty features -> 0,
    partly missing -> median, complete -> untouched. ``stats``: the
    ``order_stats`` of the rows before ``df`` clipped them."""
    if stats is None:
        mr = missing_rates(df)
        partial = [r["feature"] for r in mr.filter(F.col("status") == "partial").select("feature").collect()]
        med = quantiles(df, partial, probs=(0.5,), materialize=materialize) \
            .withColumnRenamed("q50", "median") \
            if partial else df.sparkSession.createDataFrame([], "feature string, median double")
    else:
        feats = features_of(df)
        mr = missing_rates_of(df.sparkSession, stats.rows, stats.n_of, feats)
        med = df.sparkSession.createDataFrame([(f, stats.median(f)) for f in feats if f in stats.n_of], "feature string, median double")
    p = mr.join(F.broadcast(med), "feature", "left")
    return p.select("feature", "ordinal", "missing_rate", "status",
                    F.when(F.col("status") == "empty", F.lit(0.0))
                     .when(F.col("status") == "partial", F.col("median")).alias("fill_value"))


def apply_impute(df: DataFrame, params: list[dict]) -> DataFrame:
    fills = {r["feature"]: float(r["fill_value"]) for r in params if r["fill_value"] is not None}
    return df.fillna(fills) if fills else df


# -------------------------------------------------------------- A20 / M4
def forced_features(avail: list[str], per_group: int = K.FORCED_PER_GROUP) -> list[str]:
    out = []
    for feats in K.FEATURE_GROUPS.values():
        for f in [x for x in feats if x in avail][:per_group]:
            if f not in out:
                out.append(f)
    return out


def anova_f(df: DataFrame, features: list[str], label: str = "TARGET") -> DataFrame:
    """One-way ANOVA F statistic of each feature against the label,
    from per-class count / mean / population variance (numerically stable
    sums). Undefined F (no within-class variance) is NULL."""
    # one wide aggregate: a row per class; only that is turned into (feature, class) rows
    x = df.fillna(0.0, subset=features)
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    wide = x.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *aggs)
    per = wide.select(label, "n", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{c}{i}").alias(c) for c in ("m", "v", "lo", "hi")])
        for i, f in enumerate(features)])))
    tot = per.groupBy("feature").agg(F.sum("n").alias("n_total"),
                                     (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"),
                                     F.count(F.lit(1)).alias("k"),
                                     (F.min("lo") == F.max("hi")).alias("constant"))
    j = per.join(tot, "feature")
    s = j.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("mu")) * (F.col("m") - F.col("mu"))).alias("ssb"),
                                 F.sum(F.col("n") * F.col("v")).alias("ssw"),
                                 F.first("n_total").alias("n_total"), F.first("k").alias("k"),
                                 F.first("constant").alias("constant"))
    # a constant feature has no defined F (floating noise in ssw must not make it 0)
    f = F.when(~F.col("constant") & (F.col("ssw") > 0), div(div(F.col("ssb"), F.col("k") - 1),
                                     div(F.col("ssw"), F.col("n_total") - F.col("k"))))
    return s.select("feature", f.alias("f_score"))


def select_features(df: DataFrame, max_features: int = K.MAX_FEATURES,
                    per_group: int = K.FORCED_PER_GROUP) -> DataFrame:
    """M4 + T2: first ``per_group`` features of every group are kept, the
    rest ranked by F score (undefined last, ties in catalogue order).
    Returns (rank, feature, f_score, forced).

    Scores rank by their value to six decimals: the last bits of a sum depend
    on the order in which partitions are merged, so equal features would
    change places from run to run."""
    spark = df.sparkSession
    avail = features_of(df)
    forced = forced_features(avail, per_group)
    remaining = [f for f in avail if f not in forced]
    k = max(0, min(len(remaining), max_features - len(forced)))
    ordinal = {f: i for i, f in enumerate(K.ALL_FEATURES)}
    forced_df = spark.createDataFrame([(i + 1, f, None, True) for i, f in enumerate(forced)],
                                      "rank int, feature string, f_score double, forced boolean")
    if not remaining or k == 0:
        return forced_df
    scores = anova_f(df, remaining)
    om = F.create_map(*[x for f, i in ordinal.items() for x in (F.lit(f), F.lit(i))])
    order = [F.desc_nulls_last("_score"), F.asc("ordinal")]
    ranked = (scores.withColumn("ordinal", F.element_at(om, F.col("feature"))).withColumn("_score", round6("f_score"))
              .orderBy(*order).limit(k)
              # at most one row per catalogue feature: a single-task window is fine
              .withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + len(forced)).cast("int"))
              .select("rank", "feature", "f_score", F.lit(False).alias("forced")))
    return forced_df.unionByName(ranked)


# --------------------------------------------------------------------- M5
#: Quartiles and median, of the filled columns.
SCALE_PROBS = (0.25, 0.5, 0.75)


def robust_params(df: DataFrame, features: list[str], materialize: bool = True, stats: OrderStats | None = None) -> DataFrame:
    """(feature, center, scale): median and inter-quartile range; an IQR of
    0 scales by 1 (the column is only centred). ``stats``: the ``order_stats``
    of the rows before ``df`` clipped and filled them."""
    if stats is None:
        q = quantiles(df, features, probs=SCALE_PROBS, materialize=materialize)
    else:
        q = quantile_frame(df.sparkSession, features, {(f, i): stats.filled(f, p) for f in features for i, p in enumerate(SCALE_PROBS)}, SCALE_PROBS)
    iqr = F.col("q75") - F.col("q25")
    return q.select("feature", F.col("q50").alias("center"),
                    F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def apply_scale(df: DataFrame, params: list[dict], keep: list[str] = K.META_COLUMNS) -> DataFrame:
    cols = [F.col(x) for x in keep if x in df.columns]
    for r in params:
        cols.append(((F.col(r["feature"]) - F.lit(r["center"])) / F.lit(r["scale"])).alias(r["feature"]))
    return df.select(*cols)


# ------------------------------------------------------------- pipeline
@dataclass
class PrepModel:
    """Fitted preparation: everything needed to transform new rows."""
    bounds: list[dict] = field(default_factory=list)
    fills: list[dict] = field(default_factory=list)
    selected: list[str] = field(default_factory=list)
    scales: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame, keep: list[str] = K.META_COLUMNS) -> DataFrame:
        x = apply_winsor(df, self.bounds)
        x = apply_impute(x, self.fills)
        order = {r["feature"]: r for r in self.scales}
        # complete when fitted, missing now: the fitted median
        filled = {r["feature"] for r in self.fills if r["fill_value"] is not None}
        x = x.fillna({f: float(order[f]["center"]) for f in self.selected
                      if f not in filled and order[f]["center"] is not None})
        return apply_scale(x, [order[f] for f in self.selected], keep=keep)

    def to_rows(self):
        return {"bounds": self.bounds, "fills": self.fills, "selected": self.selected, "scales": self.scales}


def fit_prep(df: DataFrame) -> PrepModel:
    """M2-M5 fitted in order on ``df`` (already cleaned and, for large
    inputs, materialised: every step below is a projection of it)."""
    st = order_stats(df)
    bounds = [r.asDict() for r in winsor_bounds(df, materialize=False, stats=st).collect()]
    w = apply_winsor(df, bounds)
    fills = [r.asDict() for r in impute_params(w, materialize=False, stats=st).collect()]
    imp = apply_impute(w, fills)
    sel = [r["feature"] for r in select_features(imp).orderBy("rank").collect()]
    scales = [r.asDict() for r in robust_params(imp, sel, materialize=False, stats=st).collect()]
    return PrepModel(bounds, fills, sel, scales)
