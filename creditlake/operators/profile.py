"""Profiling operators over the unified feature table.

Shape rules used throughout:
* simple per-feature statistics (counts, means, missing rates) are one wide
  aggregate with a partial (map-side) stage, then the single result row is
  unpivoted — no data is exploded;
* order statistics (quantiles) of all features are selected together from wide
  rows by radix passes; only class histograms run over (feature, value) rows;
* every driver-side collect is bounded by the number of catalogue features.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import catalog as K
from ..functions.expr import clip, div, right_closed_bin

# Profile bins and subsets (fixed values).
AGE_EDGES = [0, 25, 35, 45, 55, 65, 100]
AGE_LABELS = ["<25", "25-35", "35-45", "45-55", "55-65", "65+"]
LATE_EDGES = [0, 0.05, 0.1, 0.2, 0.3, 0.5]
LATE_LABELS = ["0-5%", "5-10%", "10-20%", "20-30%", "30-50%"]
KEY_FEATURES = ["credit_to_income", "age_years", "inst_late_payment_rate", "ext_source_mean",
                "cc_utilization_mean", "income_total", "employment_years",
                "bureau_debt_to_credit_ratio"]
KEY_STAT_FEATURES = ["age_years", "credit_to_income", "inst_late_payment_rate", "ext_source_mean"]
CORR_FEATURE_COUNT = 30
# Signals shown only where enough applicants have them.
GUARDED_SIGNALS = ["has_savings", "checking_account_ordinal", "employment_stability"]


def features_of(df: DataFrame) -> list[str]:
    return [f for f in K.ALL_FEATURES if f in df.columns]


def unpivot_row(row_df: DataFrame, names: list[str], prefix: str, value: str) -> DataFrame:
    """Turn a one-row wide result ``{prefix}{name}`` into (feature, value) rows."""
    return row_df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"{prefix}{n}").alias(value)) for n in names
    ])).alias("s")).select("s.*")


def long_form(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., feature, value) rows; used where work must spread by feature."""
    keep = list(keep)
    return (df.select(*keep, *[F.col(f).cast("double") for f in features])
            .unpivot(keep, features, "feature", "value"))


# ---------------------------------------------------------------- A8 / A9
def dataset_overview(df: DataFrame) -> DataFrame:
    """Rows, columns, default rate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.avg("TARGET").alias("default_rate")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long"))


def source_counts(df: DataFrame) -> DataFrame:
    """A9 + A10 by source: rows and default rate per source."""
    return df.filter(F.col("source_dataset").isNotNull()).groupBy("source_dataset").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("TARGET").alias("default_rate"))


# ------------------------------------------------------------------- A10
def profile_keys(df: DataFrame, include_zero_late: bool = True) -> dict[str, Column]:
    """The binned keys the default-rate profile groups by. The first late
    bucket includes a rate of exactly 0 unless ``include_zero_late`` is off
    (then, as with a plain right-closed cut, 0 falls in no bucket)."""
    late = clip("inst_late_payment_rate", 0, 0.5)
    late_bucket = right_closed_bin(late, LATE_EDGES, LATE_LABELS)
    if include_zero_late:
        late_bucket = F.when(late == 0, F.lit(LATE_LABELS[0])).otherwise(late_bucket)
    return {
        "source_dataset": F.col("source_dataset"),
        "age_group": right_closed_bin("age_years", AGE_EDGES, AGE_LABELS),
        "employed_flag": F.col("employed_flag").cast("string"),
        "has_loan_history": F.col("has_loan_history").cast("string"),
        "has_savings": F.col("has_savings").cast("string"),
        "checking_account_ordinal": F.col("checking_account_ordinal").cast("string"),
        "employment_stability": F.col("employment_stability").cast("string"),
        "late_bucket": late_bucket,
    }


def alternative_signals(df: DataFrame, min_present: int = 100) -> DataFrame:
    """A10 + F4: default rates by the signals for applicants without a credit
    history; a signal with ``min_present`` values or fewer is left out."""
    known = df.agg(*[F.count(f).alias(f) for f in GUARDED_SIGNALS]).first()  # a few numbers
    return default_rate_by_key(df, keys=[f for f in GUARDED_SIGNALS if known[f] > min_present] + ["late_bucket"])


def default_rate_by_key(df: DataFrame, include_zero_late: bool = True, keys: list[str] | None = None) -> DataFrame:
    """A10: default rate for every key (or those named) in one pass (an Expand of the rows into
    one (dimension, key) pair per key, partial-aggregated before the shuffle,
    i.e. grouping sets). Rows whose key is missing are dropped per key."""
    every = profile_keys(df, include_zero_late)
    keys = {k: e for k, e in every.items() if keys is None or k in keys}
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), e.cast("string").alias("key"))
                      for k, e in keys.items()])
    x = df.select(F.col("TARGET"), F.explode(pairs).alias("p")).select("p.dimension", "p.key", "TARGET")
    return x.filter(F.col("key").isNotNull()).groupBy("dimension", "key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("TARGET").alias("default_rate"))


# ----------------------------------------------------------- A11-A13, T1
def missing_rates(df: DataFrame) -> DataFrame:
    """A11 + A13: per feature missing rate and complete/partial/empty status."""
    feats = features_of(df)
    rows = F.count(F.lit(1))
    wide = df.agg(*[F.try_divide((rows - F.count(f)).cast("double"), rows).alias(f"m_{f}") for f in feats])
    return _with_status(unpivot_row(wide, feats, "m_", "missing_rate"))


def _with_status(long: DataFrame) -> DataFrame:
    ordinal = F.create_map(*[x for i, f in enumerate(K.ALL_FEATURES) for x in (F.lit(f), F.lit(i))])
    mr = F.col("missing_rate")
    return long.select(
        "feature", F.element_at(ordinal, F.col("feature")).alias("ordinal"), "missing_rate",
        F.when(mr == 0, "complete").when(mr == 1, "empty").otherwise("partial").alias("status"))


def missing_rates_of(spark, rows: int, n_of: dict[str, int], features: list[str]) -> DataFrame:
    """``missing_rates`` from counts: the rows, and the values of each feature."""
    rates = [(f, (rows - n_of.get(f, 0)) / rows if rows else None) for f in features]
    return _with_status(spark.createDataFrame(rates, "feature string, missing_rate double"))


def top_missing(df: DataFrame, k: int = 30) -> DataFrame:
    """The k most-missing features (ties in catalogue order)."""
    return missing_rates(df).orderBy(F.desc("missing_rate"), F.asc("ordinal")).limit(k)


def coverage_by_source(df: DataFrame) -> DataFrame:
    """Percent of non-missing values per source x feature."""
    feats = features_of(df)
    wide = df.groupBy("source_dataset").agg(
        *[(F.avg(F.col(f).isNotNull().cast("double")) * 100).alias(f"c_{f}") for f in feats])
    return wide.unpivot(["source_dataset"], [f"c_{f}" for f in feats], "feature", "coverage_pct") \
        .withColumn("feature", F.expr("substring(feature, 3)"))


# ------------------------------------------------------------- A14, A15
def class_balance(df: DataFrame) -> DataFrame:
    """A14 + A23: class counts, shares, imbalance ratio and class weight."""
    y = F.col("TARGET")
    g = df.agg(F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive"),
               F.count(F.lit(1)).alias("n_rows"))
    return g.select(
        "n_negative", "n_positive",
        div("n_negative", "n_rows").alias("share_negative"),
        div("n_positive", "n_rows").alias("share_positive"),
        div("n_negative", "n_positive").alias("imbalance_ratio"),
        F.round(div("n_negative", "n_positive"), 2).alias("class_weight"))


def cohort_rates(df: DataFrame) -> DataFrame:
    """New (no loan history) vs existing users: size, share, default rate."""
    new = F.col("has_loan_history") == 0
    ex = F.col("has_loan_history") == 1
    return df.agg(
        F.count_if(new).alias("n_new"), F.count_if(ex).alias("n_existing"),
        F.avg(new.cast("double")).alias("share_new"),
        F.avg(F.when(new, F.col("TARGET"))).alias("default_rate_new"),
        F.avg(F.when(ex, F.col("TARGET"))).alias("default_rate_existing"))


# ------------------------------------------------------------------- A16
def corr_matrix(df: DataFrame, n_features: int = CORR_FEATURE_COUNT) -> DataFrame:
    """Pairwise-complete Pearson correlation of the first numeric
    features and the label (upper triangle incl. diagonal).

    A task reduces its rows to one co-moment row per pair (count, means and
    centred sums over the rows where both columns are present; batches are
    merged by the parallel update formulas), so a pair whose columns overlap in
    a small, differently centred part of the table keeps full precision. The
    per-task rows are written once and merged in two small aggregates: means
    first, then the centred sums around them."""
    cols = features_of(df)[:n_features] + ["TARGET"]
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spark = df.sparkSession
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    ii = np.array([p[0] for p in pairs])
    jj = np.array([p[1] for p in pairs])

    def partials(batches):
        total = None
        for pdf in batches:
            part = _co_moments(pdf.to_numpy(dtype=float, na_value=np.nan))
            total = part if total is None else _merge_co_moments(total, part)
        if total is not None:
            n, mean, m2, cross, lo, hi = total
            yield pd.DataFrame({
                "pair": np.arange(len(pairs)), "n": n[ii, jj], "ma": mean[ii, jj], "mb": mean[jj, ii],
                "qa": m2[ii, jj], "qb": m2[jj, ii], "c": cross[ii, jj],
                "lo_a": lo[ii, jj], "hi_a": hi[ii, jj], "lo_b": lo[jj, ii], "hi_b": hi[jj, ii]})

    names = "n ma mb qa qb c lo_a hi_a lo_b hi_b".split()
    from ..session import cut_lineage
    parts = cut_lineage(x.mapInPandas(partials, "pair long, " + ", ".join(f"{c} double" for c in names))
                        .filter("n > 0"), "co-moments")
    means = parts.groupBy("pair").agg(F.sum("n").alias("nn"), (F.sum(F.col("n") * F.col("ma")) / F.sum("n")).alias("mean_a"),
                                      (F.sum(F.col("n") * F.col("mb")) / F.sum("n")).alias("mean_b"))
    da, db = F.col("ma") - F.col("mean_a"), F.col("mb") - F.col("mean_b")
    g = parts.join(means, "pair").groupBy("pair").agg(
        F.first("nn").alias("n"), F.sum(F.col("qa") + F.col("n") * da * da).alias("va"),
        F.sum(F.col("qb") + F.col("n") * db * db).alias("vb"), F.sum(F.col("c") + F.col("n") * da * db).alias("cov"),
        F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"), F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b"))
    defined = (F.col("n") >= 2) & (F.col("lo_a") < F.col("hi_a")) & (F.col("lo_b") < F.col("hi_b"))
    r = F.when(defined, div(F.col("cov"), F.sqrt("va") * F.sqrt("vb")))
    labels = spark.createDataFrame([(p, cols[a], cols[b]) for p, (a, b) in enumerate(pairs)],
                                   "pair long, feature_a string, feature_b string")
    # one row per pair of columns on both sides
    out = labels.join(F.broadcast(g.select("pair", r.alias("corr"))), "pair", "left")
    return out.select("feature_a", "feature_b", clip("corr", -1.0, 1.0).alias("corr"))


def _co_moments(v: np.ndarray):
    """Per ordered column pair (a, b), over the rows where both are present:
    count, mean of a, centred sum of squares of a, centred cross sum, min and
    max of a."""
    m = ~np.isnan(v)
    k = v.shape[1]
    z = np.where(m, v, 0.0)
    n = m.T.astype(float) @ m
    mean = np.divide(z.T @ m, n, out=np.zeros((k, k)), where=n > 0)
    m2, cross = np.zeros((k, k)), np.zeros((k, k))
    lo, hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
    for a in range(k):
        rows = m[:, a]
        if not rows.any():
            continue
        va, both = v[rows, a][:, None], m[rows]
        d = np.where(both, va - mean[a], 0.0)
        m2[a] = (d * d).sum(axis=0)
        cross[a] = (d * np.where(both, z[rows] - mean[:, a], 0.0)).sum(axis=0)
        lo[a] = np.where(both, va, np.inf).min(axis=0)
        hi[a] = np.where(both, va, -np.inf).max(axis=0)
    return n, mean, m2, cross, lo, hi


def _merge_co_moments(x, y):
    """Parallel update of two co-moment sets."""
    n = x[0] + y[0]
    w = np.divide(x[0] * y[0], n, out=np.zeros_like(n), where=n > 0)
    d = np.where((x[0] > 0) & (y[0] > 0), y[1] - x[1], 0.0)
    mean = np.divide(x[0] * x[1] + y[0] * y[1], n, out=np.zeros_like(n), where=n > 0)
    return (n, mean, x[2] + y[2] + w * d * d, x[3] + y[3] + w * d * d.T,
            np.minimum(x[4], y[4]), np.maximum(x[5], y[5]))


def label_correlations(df: DataFrame) -> DataFrame:
    """Feature correlations with the label, in ascending order."""
    m = corr_matrix(df)
    return (m.filter((F.col("feature_b") == "TARGET") & (F.col("feature_a") != "TARGET"))
            .select(F.col("feature_a").alias("feature"), "corr").orderBy("corr", "feature"))


# ---------------------------------------------------------------- A18/A19
#: Bits of the sort key that each selection pass settles (64 in all).
RADIX_BITS = (12, 13, 13, 13, 13)


def quantiles(df: DataFrame, features: list[str] | None = None,
              probs=(0.01, 0.25, 0.5, 0.75, 0.99), materialize: bool = True) -> DataFrame:
    """Per feature linearly interpolated quantiles (NULLs skipped),
    one row per feature with at least one value: (feature, q01, q25, ...).

    Exact and memory-bounded: see ``exact_quantiles``."""
    feats = features or features_of(df)
    src = df.select(*feats)
    if materialize:
        from ..session import cut_lineage
        src = cut_lineage(src, "quantile-input")  # the passes below re-read it
    return quantile_frame(df.sparkSession, feats, exact_quantiles(src, feats, probs), probs)


def quantile_frame(spark, feats: list[str], found: dict, probs) -> DataFrame:
    """(feature, q01, q25, ...) rows of {(feature, index of p): quantile}."""
    rows = [(f, *[found.get((f, i)) for i in range(len(probs))]) for f in feats if (f, 0) in found]
    schema = "feature string, " + ", ".join(f"{_qname(p)} double" for p in probs)
    return spark.createDataFrame(rows, schema)


def around(n: int, p: float) -> tuple[int, int]:
    """The ranks between which the quantile p of n values lies."""
    lo = int(p * (n - 1))
    return lo, min(lo + 1, n - 1)


def between(n: int, p: float, v0: float, v1: float) -> float:
    """The quantile p of n values from those at its ranks."""
    h = p * (n - 1)
    return v0 if v0 == v1 else v0 + (h - int(h)) * (v1 - v0)


def exact_quantiles(df: DataFrame, features: list[str], probs) -> dict:
    """Exact interpolated quantiles of wide numeric columns, NULLs skipped.
    Returns {(feature, index of p): quantile} of the features with a value.

    h = p * (n - 1) lies between the order statistics of ranks floor(h) and
    floor(h) + 1, which ``radix_select`` finds for all features together."""
    keys = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    n_of, found = radix_select(keys, features, lambda n: sorted({r for p in probs for r in around(n, p)}))
    return {(f, i): between(n, p, *(float(from_key(found[f, r])) for r in around(n, p)))
            for f, n in n_of.items() for i, p in enumerate(probs)}


def sort_keys(v: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles (-0.0 counts as 0.0, NaN is largest); integers are their own keys."""
    if v.dtype != np.float64:
        return v.astype(np.int64)
    bits = (v + 0.0).view(np.int64)
    bits = np.where(np.isnan(v), np.int64(0x7FF8000000000000), bits)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def from_key(k: int) -> float:
    k = np.int64(k)
    return (k ^ ((k >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)


def radix_select(df: DataFrame, columns: list[str], ranks) -> tuple[dict, dict]:
    """Order statistics of many columns (double or 64-bit integer) at once.

    ``ranks(n)`` gives the wanted 0-based ranks for a column with n values.
    Each pass settles the next ``RADIX_BITS`` of the sort key of every wanted
    rank: a task sorts its batches' keys and counts them by their leading
    bits (of values that share a settled prefix only), counts are aggregated
    with the least and greatest key of each bucket, and one group a column
    picks the buckets that hold its ranks.  A bucket with one distinct key is
    the answer, so columns of few values end early, and columns that are
    done aren't read again.  A column has at most 2^13 buckets a prefix, a
    few ranks reach the driver.  Returns ({column: n}, {(column, rank): key})."""
    spark = df.sparkSession
    n_of: dict = {}
    found: dict = {}
    shift = 64
    open_: dict = {i: None for i in range(len(columns))}   # column -> {prefix: [(rank, rank inside the prefix)]}
    for bits in RADIX_BITS:
        shift -= bits
        at = sorted(open_)
        prefixes = {i: None if open_[i] is None else np.array(sorted(open_[i]), np.int64) for i in at}
        tops = df.select(*[columns[i] for i in at]).mapInArrow(_top_counts(at, prefixes, shift, shift + bits), "col int, top long, n long, lo long, hi long")
        sums = tops.groupBy("col", "top").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        picked = sums.groupBy("col").applyInArrow(_pick(open_, bits, ranks), "col int, rank long, inside long, top long, lo long, hi long, total long")
        open_next: dict = {}
        for r in picked.collect():  # a few ranks a column
            f = columns[r["col"]]
            n_of.setdefault(f, r["total"])
            if r["rank"] is None:
                continue
            if r["lo"] == r["hi"]:
                found[f, r["rank"]] = r["lo"]
            else:
                open_next.setdefault(r["col"], {}).setdefault(r["top"], []).append((r["rank"], r["inside"]))
        open_ = open_next
        if not open_:
            break
    return n_of, found


def _top_counts(at: list[int], prefixes: dict, shift: int, settled: int):
    """Counts of the keys by their bits above ``shift``, among those whose bits above ``settled`` are a prefix."""
    import pyarrow as pa

    def combine(parts):
        col, top, n, lo, hi = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((top, col))
        col, top, n, lo, hi = col[order], top[order], n[order], lo[order], hi[order]
        first = np.flatnonzero(np.concatenate(([True], (col[1:] != col[:-1]) | (top[1:] != top[:-1]))))
        return (col[first], top[first], np.add.reduceat(n, first), np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first))

    def run(batches):
        parts, held = [], 0
        for b in batches:
            for k, i in enumerate(at):
                v = b.column(k).drop_null()
                if not len(v):
                    continue
                keys = sort_keys(v.to_numpy(zero_copy_only=False))
                if prefixes[i] is not None:
                    own = keys >> settled
                    p = prefixes[i]
                    keys = keys[p[np.minimum(np.searchsorted(p, own), len(p) - 1)] == own]
                    if not len(keys):
                        continue
                keys = np.sort(keys)
                top = keys >> shift
                first = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
                last = np.append(first[1:], len(keys))
                parts.append((np.full(len(first), i, np.int32), top[first], last - first, keys[first], keys[last - 1]))
                held += len(first)
            if held > 2_000_000:
                parts = [combine(parts)]
                held = len(parts[0][0])
        if parts:
            out = combine(parts)
            for k in range(0, len(out[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[k:k + 100_000]) for x in out], ["col", "top", "n", "lo", "hi"])

    return run


def _pick(open_: dict, bits: int, ranks):
    """The buckets of a column that hold its wanted ranks."""
    import pyarrow as pa

    def run(group):
        group = group.sort_by("top")
        col = group.column("col")[0].as_py()
        top, n, lo, hi = (group.column(c).to_numpy() for c in ("top", "n", "lo", "hi"))
        total = int(n.sum())
        out = []
        wanted = open_[col]
        if wanted is None:
            wanted = {None: [(r, r) for r in ranks(total)]}
        for prefix, inner in wanted.items():
            mine = np.arange(len(top)) if prefix is None else np.flatnonzero(top >> bits == prefix)
            ends = np.cumsum(n[mine])
            for rank, inside in inner:
                k = int(np.searchsorted(ends, inside, "right"))
                j = mine[k]
                out.append((col, rank, inside - int(ends[k] - n[j]), int(top[j]), int(lo[j]), int(hi[j]), total))
        if not out:
            out.append((col, None, None, None, None, None, total))
        kinds = [pa.int32()] + [pa.int64()] * 6
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["col", "rank", "inside", "top", "lo", "hi", "total"])

    return run


def _qname(p) -> str:
    return f"q{round(p * 100):02d}"


def key_stats(df: DataFrame, features=KEY_STAT_FEATURES) -> DataFrame:
    """Mean / median / sample std / missing rate of the key features."""
    feats = [f for f in features if f in df.columns]
    aggs = []
    for f in feats:
        v = F.col(f).cast("double")
        aggs += [F.avg(v).alias(f"mean_{f}"), F.stddev_samp(v).alias(f"std_{f}"), F.avg(v.isNull().cast("double")).alias(f"mr_{f}"),
                 F.count(v).alias(f"n_{f}")]
    wide = df.agg(*aggs)
    st = wide.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"mean_{f}").alias("mean"), F.col(f"std_{f}").alias("std"), F.col(f"mr_{f}").alias("missing_rate"),
                 F.col(f"n_{f}").alias("n_present")) for f in feats])))
    med = quantiles(df, feats, probs=(0.5,)).withColumnRenamed("q50", "median")
    return st.join(med, "feature", "left").select("feature", "mean", "median", "std", "missing_rate", "n_present")


# ------------------------------------------------------------------- A17
def histogram(df: DataFrame, features: list[str], bins: int = 40) -> DataFrame:
    """Counts of each feature's values in ``bins`` equal bins from its least
    to its greatest value (NULLs skipped): (feature, bin, bin_lo, bin_hi, count).

    Two wide passes: one aggregate for the ranges, then one that counts all bins of
    a feature in each task (an array of ``bins`` numbers a feature), so rows are neither
    exploded nor shuffled."""
    feats = [f for f in features if f in df.columns]
    v = {f: F.col(f).cast("double") for f in feats}
    ends = df.agg(*[x for f in feats for x in (F.min(v[f]).alias(f"a_{f}"), F.max(v[f]).alias(f"b_{f}"))]).first()  # two numbers a feature
    feats = [f for f in feats if ends[f"a_{f}"] is not None]
    rows, aggs = [], []
    for f in feats:
        lo, hi = ends[f"a_{f}"], ends[f"b_{f}"]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / bins
        b = F.least(F.floor((v[f] - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        for k in range(bins):
            aggs.append(F.count_if(b == k).alias(f"c{len(rows)}"))
            rows.append((f, k, lo + k * width, lo + (k + 1) * width))
    schema = "feature string, bin int, bin_lo double, bin_hi double, count long"
    got: list = []
    for at in range(0, len(aggs), 40 * bins):  # a bounded number of counters a pass
        got += list(df.agg(*aggs[at:at + 40 * bins]).first())
    return df.sparkSession.createDataFrame([(*r, n) for r, n in zip(rows, got, strict=True)], schema)


def class_histogram(df: DataFrame, features=KEY_FEATURES, bins: int = 50,
                    min_present: int = 100, cap: bool = True) -> DataFrame:
    """Class-conditional density histograms, values capped above at the
    feature's 99th percentile (unless ``cap`` is off); each class gets its own [min, max] range."""
    from ..session import cut_lineage
    feats = [f for f in features if f in df.columns]
    df = cut_lineage(df.select("TARGET", *feats), "histogram-input")  # four passes read it
    lf = long_form(df, feats, keep=["TARGET"]).filter(F.col("value").isNotNull())
    present = lf.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    if cap:
        present = present.join(quantiles(df, feats, probs=(0.99,), materialize=False).withColumnRenamed("q99", "cap"), "feature")
    else:
        present = present.withColumn("cap", F.lit(float("inf")))
    lf = lf.join(F.broadcast(present.filter(F.col("_n") > min_present)), "feature")
    lf = lf.filter(F.col("TARGET").isNotNull()).withColumn("x", F.least("value", "cap"))
    rng = lf.groupBy("feature", "TARGET").agg(F.min("x").alias("lo"), F.max("x").alias("hi"),
                                              F.count(F.lit(1)).alias("n"))
    x = lf.join(F.broadcast(rng), ["feature", "TARGET"])
    same = F.col("hi") == F.col("lo")
    lo = F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi"))
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    h = x.withColumn("bin", b).groupBy("feature", "TARGET", "bin").agg(
        F.count(F.lit(1)).alias("count"), F.first("lo").alias("_lo"), F.first("hi").alias("_hi"),
        F.first("n").alias("_n"))
    lo2 = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi2 = F.when(F.col("_hi") == F.col("_lo"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    w2 = (hi2 - lo2) / bins
    return h.select("feature", "TARGET", "bin",
                    (lo2 + F.col("bin") * w2).alias("bin_lo"),
                    (lo2 + (F.col("bin") + 1) * w2).alias("bin_hi"),
                    "count",
                    (F.col("count") / (F.col("_n") * w2)).alias("density"))


def missing_before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Missing rate of each feature before vs after preparation."""
    a = missing_rates(before).select("feature", F.col("missing_rate").alias("missing_before"))
    b = missing_rates(after).select("feature", F.col("missing_rate").alias("missing_after"))
    return a.join(b, "feature", "inner")


def union_all(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)
