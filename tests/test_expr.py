"""Null and rounding rules of the expression helpers."""
from pyspark.sql import functions as F

from creditlake.functions import expr as X


def one(spark, ddl, rows, *cols):
    return spark.createDataFrame(rows, ddl).select(*cols).collect()


def test_flag_null_is_zero(spark):
    r = one(spark, "x double", [(None,), (1.0,), (-1.0,)], X.flag(F.col("x") > 0).alias("f"))
    assert [x.f for x in r] == [0, 1, 0]


def test_ratio1_and_div_never_raise(spark):
    r = one(spark, "a double, b double", [(1.0, None), (2.0, 1.0), (1.0, -1.0), (4.0, 0.0)],
            X.ratio1("a", "b").alias("r"), X.div("a", "b").alias("d"))
    assert r[0].r is None and r[1].r == 1.0 and r[2].r is None
    assert r[3].d is None


def test_clip_keeps_null(spark):
    r = one(spark, "x double", [(None,), (-3.0,), (9.0,), (0.5,)], X.clip("x", 0, 1).alias("c"))
    assert [x.c for x in r] == [None, 0.0, 1.0, 0.5]


def test_rowwise_stats_skip_nulls(spark):
    st = X.rowwise_stats(["a", "b", "c"])
    r = one(spark, "a double, b double, c double",
            [(1.0, None, None), (None, None, None), (1.0, 2.0, 3.0)],
            st["mean"].alias("m"), st["std"].alias("s"), st["min"].alias("mn"), st["count"].alias("n"))
    assert (r[0].m, r[0].s, r[0].mn, r[0].n) == (1.0, None, 1.0, 1.0)
    assert (r[1].m, r[1].s, r[1].mn, r[1].n) == (None, None, None, 0.0)
    assert (r[2].m, r[2].s, r[2].mn) == (2.0, 1.0, 1.0)


def test_row_sum_all_null_is_zero(spark):
    r = one(spark, "a double, b double", [(None, None), (1.0, None)], X.row_sum(["a", "b"]).alias("s"))
    assert [x.s for x in r] == [0.0, 1.0]


def test_right_closed_bin_edges(spark):
    e = X.right_closed_bin("x", [float("-inf"), 0, 200, 1000, float("inf")], [1, 2, 3, 4])
    r = one(spark, "x double", [(0.0,), (0.1,), (200.0,), (1000.0,), (1000.5,), (None,)], e.alias("b"))
    assert [x.b for x in r] == [1, 2, 2, 3, 4, None]


def test_text_parsers(spark):
    r = one(spark, "t string, u string", [(" 36 months", "12.5%"), ("none", "n/a"), (None, "40")],
            X.parse_first_int("t").alias("n"), X.parse_percent("u").alias("p"))
    assert (r[0].n, r[0].p) == (36.0, 0.125)
    assert (r[1].n, r[1].p) == (None, None)
    assert (r[2].n, r[2].p) == (None, 0.4)


def test_bround_is_half_even(spark):
    r = one(spark, "x double", [(0.25,), (0.35,), (2.5,)], X.bround("x", 1).alias("a"), X.bround("x", 0).alias("b"))
    assert r[0].a == 0.2 and r[2].b == 2.0


def test_round6_matches_ieee_steps(spark):
    r = one(spark, "x double", [(19475.7596875,), (-0.0000001,)], X.round6("x").alias("r"))
    assert r[0].r == round(19475.7596875 * 1e6) / 1e6 or r[0].r == 19475.759688
    assert str(r[1].r) == "0.0"
