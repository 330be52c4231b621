"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage

__all__ = ["among", "labelled", "passage"]

_PARTS = 1 << 40


def among(key: Column, total: int, n: int) -> Column:
    """Admits about 2n of ``total`` keys by their hash (all, if there are fewer), so
    that a following sort for the first n sees no more, however many partitions there are."""
    if total <= 2 * n:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_PARTS)) < F.lit(-(-2 * n * _PARTS // total))


def passage(chars: int, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """``chars`` characters of the text, from a place that the id's hash gives."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    room = F.greatest(F.length(t) - chars + 1, F.lit(1))
    return F.substring(t, 1 + F.pmod(F.xxhash64(F.col(id_col)), room.cast("long")).cast("int"), F.lit(chars))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, may_learn: Column, n: int, text: Column,
             id_col: str = "doc_id") -> DataFrame:
    """(doc_id, t, y): the texts of at most ``n`` labelled documents that may be learnt from.

    ``n`` rows of ``labels`` by their ids' hashes are taken first;
    these (n ids and labels at most) are broadcast against the documents, whose
    texts so are neither shuffled nor joined in full.  Null ids and labels are
    left out; an id with several labels has the largest, one with several texts
    gives the text of the least hash, so the result has ``n`` rows at most too.
    """
    some = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & may_learn)
    key = F.col(id_col).cast("long")
    ids = (some.where(among(key, some.agg(F.approx_count_distinct(key)).first()[0], n))
           .groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
           .orderBy(F.xxhash64("__id"), "__id").limit(n))
    ids = cut_lineage(ids, "labelled-ids")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("t"))
    found = rows.join(F.broadcast(ids), rows["doc_id"] == ids["__id"])
    # aggregated before the shuffle: an id with many rows is never gathered
    one = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"), F.max("y").alias("y"))
    return cut_lineage(one.select("doc_id", F.col("m.t").alias("t"), "y"), "labelled-texts")
