"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.session import cut_lineage, ensure_checkpoint_dir, table_path

__all__ = ["cut_lineage", "read", "vocabulary", "crc_bucket", "row_key", "components", "map_texts", "shared_dir", "WORD_SPLIT"]

#: Rows of a batch that goes to Python with texts, at most.
TEXT_ROWS = 1000
#: What separates words: space and the five ASCII control blanks.
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def vocabulary() -> str:
    """The vocabulary file of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def map_texts(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` for rows with texts, which can be long: batches of at most
    ``TEXT_ROWS`` rows.  The session's setting is lowered to it if it is larger,
    and stays so, since it is read when the plan runs."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(fn, schema)


def crc_bucket(id_col: str, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit key of a row's id and text (null and empty text differ); equal rows share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two long columns.  Returns (node, root): every node that
    occurs in an edge, with the smallest node reachable from it.  Minima are
    aggregated before the shuffle and joined back, so the neighbours of a hub
    are never gathered in one task.  Each round is written to the checkpoint
    folder; rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = both.join(m, "u")
        if large:
            out = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                m.select("u", F.col("m").alias("v")))
        return out.where(F.col("u") != F.col("v")).distinct()

    e = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .where("u <> v").distinct(), "edges")
    before = state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = cut_lineage(star(star(e, True), False), "stars")
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
