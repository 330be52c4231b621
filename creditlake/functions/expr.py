"""Column-expression helpers shared by every operator.

All helpers return JVM-side ``Column`` expressions (no Python UDFs), so the
whole feature plan stays inside whole-stage codegen. They encode the null
rules of the pandas pipeline: a comparison with a missing value is false
when turned into a 0/1 flag, a ratio with a missing operand is missing,
division never raises (ANSI mode) and NaN never leaks into the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_d(v) -> Column:
    return F.lit(v).cast("double")


def null_d() -> Column:
    return F.lit(None).cast("double")


def div(a, b) -> Column:
    """a / b that yields NULL (never an error, never inf) when b is 0."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def ratio1(a, b, k: float = 1.0) -> Column:
    """Smoothed ratio a / (b + k)."""
    return div(a, c(b) + F.lit(k))


def flag(pred: Column) -> Column:
    """Predicate -> 0/1 integer; a NULL predicate (missing operand) gives 0."""
    return F.coalesce(pred, F.lit(False)).cast("int")


def clip(x, lo=None, hi=None) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    x = c(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(x.isNull(), null_d()).otherwise(out.cast("double"))


def ladder(pairs, default) -> Column:
    """Nested conditional: first true condition wins, NULL falls through."""
    expr = None
    for cond, val in pairs:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr.otherwise(default)


def right_closed_bin(x, edges, labels) -> Column:
    """Interval bin with right-closed edges (lo, hi]; outside -> NULL."""
    x = c(x)
    pairs = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        pairs.append((cond, F.lit(lab)))
    return ladder(pairs, F.lit(None))


def col_or(df: DataFrame, name: str, default) -> Column:
    """Column if present in ``df`` else a literal default."""
    if name in df.columns:
        return F.col(name)
    return F.lit(default)


def bround(x, n: int = 0) -> Column:
    """Half-even rounding, as Python's round and pandas' Series.round."""
    return F.bround(c(x), n)


def rowwise_stats(cols) -> dict[str, Column]:
    """Row-wise mean / sample std / min / non-null count over columns,
    skipping NULLs (std of fewer than two values is NULL)."""
    cs = [c(x).cast("double") for x in cols]
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in cs])
    s = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in cs])
    mean = F.when(n > 0, s / n)
    ss = reduce(lambda a, b: a + b,
                [F.when(x.isNotNull(), F.pow(x - mean, 2)).otherwise(F.lit(0.0)) for x in cs])
    std = F.when(n > 1, F.sqrt(ss / (n - 1)))
    mn = F.least(*cs)  # least skips NULLs, all-NULL -> NULL
    return {"mean": mean, "std": std, "min": mn, "count": n.cast("double")}


def row_sum(cols) -> Column:
    """Row-wise sum skipping NULLs; all-NULL -> 0."""
    if not cols:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, [F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols])


def parse_first_int(x) -> Column:
    """First run of digits as a double (' 36 months' -> 36.0); none -> NULL."""
    return F.expr(f"try_cast(nullif(regexp_extract({_sql(x)}, '(\\\\d+)', 1), '') as double)")


def parse_percent(x) -> Column:
    """'12.5%' or '12.5' -> 0.125; unparseable -> NULL."""
    return div(F.expr(f"try_cast(regexp_replace(cast({_sql(x)} as string), '%', '') as double)"),
               F.lit(100.0))


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("SQL helpers take a column name")


def round6(x, places: int = 6) -> Column:
    """Round to ``places`` decimals as round(x * 10^p) / 10^p with ties away
    from zero: the same IEEE steps the SQL oracle performs, so exact ties
    (common for money / 12 and the like) resolve identically. ``+ 0.0``
    turns a negative zero into zero."""
    scale = float(10 ** places)
    return F.round(c(x) * F.lit(scale), 0) / F.lit(scale) + F.lit(0.0)


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (result presentation / oracle comparison)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            out.append(round6(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
