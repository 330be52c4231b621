"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over ``WINDOW`` bytes ends a chunk wherever it is ``block - 1``
modulo the block size, so chunk ends move with the text.  Each chunk's hash
gives one sign of the signature.  The block size is the least ``3 * 2**k`` by
which about ``LENGTH`` chunks are to be expected; a text whose chunks turn out
to be fewer than half of that has it halved.  A fingerprint is
``block:signature:signature at twice the block``.

``likeness`` compares signatures of the same block size, which two fingerprints
have if their blocks are equal or one is twice the other: 1 less the edit
distance (inserted and deleted signs) over the lengths.  Signatures without a
common run of ``RUN`` signs count as unlike; equal fingerprints have likeness 1.

``against_next`` lines documents up by descending id: one shuffle of the texts, by
ranges.  A task reads its range in order and keeps one document back; the last
of each range meets the first of the next range in a step of its own over one
row a range.

Defined results: a null text is empty; null ids come last, equal ids by the
text's hash; equal rows are each other's neighbours; a lone document is its own
neighbour; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage, map_texts

WINDOW, LENGTH, MIN_BLOCK, RUN = 7, 64, 3, 4
SEGMENT = 1 << 20
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_MULT = np.uint32(0x01000193)


def rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes that end at each byte; ``raw`` has ``WINDOW - 1`` bytes before the first."""
    b = raw.astype(np.uint32)
    n = len(b) - WINDOW + 1
    out = b[:n].copy()
    for k in range(1, WINDOW):
        out *= _MULT
        out += b[k:k + n]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out


def ends(text: bytes, block: int, limit: int) -> np.ndarray:
    """Where the first ``limit`` chunks end; the hash is taken a segment at a time."""
    found, total = [], 0
    for lo in range(0, len(text), SEGMENT):
        head = text[max(lo - WINDOW + 1, 0):lo]
        part = np.frombuffer(bytes(WINDOW - 1 - len(head)) + head + text[lo:lo + SEGMENT], np.uint8)
        at = np.flatnonzero(rolling(part) % np.uint32(block) == block - 1) + lo + 1
        found.append(at)
        total += len(at)
        if total >= limit:
            break
    return np.concatenate(found)[:limit] if found else np.zeros(0, np.int64)


def signature(text: bytes, at: np.ndarray) -> str:
    """A sign for each chunk; the last one runs to the text's end."""
    view, lo, out = memoryview(text), 0, []
    for hi in (*at.tolist(), len(text)):
        if hi > lo:
            out.append(SIGNS[xxhash.xxh64_intdigest(view[lo:hi]) >> 58])
        lo = hi
    return "".join(out)


def fingerprint(text: bytes) -> str:
    block = MIN_BLOCK
    while block * LENGTH < len(text):
        block *= 2
    while True:
        at = ends(text, block, LENGTH - 1)
        if len(at) >= LENGTH // 2 - 1 or block == MIN_BLOCK:
            break
        block //= 2
    return f"{block}:{signature(text, at)}:{signature(text, ends(text, 2 * block, LENGTH // 2 - 1))}"


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each sign of ``a``."""
    mask: dict = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every
    for c in b:
        u = v & mask.get(c, 0)
        v = (v + u | v - u) & every
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    if not run or {a[i:i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i:i + run] for i in range(len(b) - run + 1)):
        return 0.0
    # edit distance: len(a) + len(b) - 2 common
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if x == y:
        return 1.0
    (p, a, a2), (q, b, b2) = x.split(":"), y.split(":")
    p, q = int(p), int(q)
    if p == q:
        return max(_alike(a, b), _alike(a2, b2))
    if p == 2 * q:
        return _alike(a, b2)
    return _alike(a2, b) if q == 2 * p else 0.0


def edited(text: bytes, following: bytes) -> bytes:
    """The text with its last third replaced by as many code points of the next document's begin (or all of it)."""
    s = text.decode("utf-8", "replace")
    n = len(s) // 3
    return (s[:len(s) - n] + following[:4 * n].decode("utf-8", "ignore")[:n]).encode()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint): every text's fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t) for t in b.column(2).to_pylist()], pa.string())],
                                             ["doc_id", "n_chars", "fingerprint"])

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return map_texts(docs.select(docs[id_col].cast("long"), F.length(text).cast("long"), text.cast("binary")), run,
                     "doc_id long, n_chars long, fingerprint string")


ROWS = {"kind": pa.int32(), "part": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
        "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(), "text": pa.binary()}
ROWS_DDL = ("kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, text binary")
DONE, FIRST, LAST = 0, 1, 2


def _compared(this: dict, following: dict) -> tuple:
    """The result row of a document and its next one."""
    text = edited(this["text"], following["text"])
    own, other = this["fingerprint"], fingerprint(text)
    return (DONE, this["part"], this["doc_id"], this["n_chars"], hashlib.sha256(text).hexdigest(), own, other, likeness(own, other),
            likeness(own, following["fingerprint"]), None)


def _kept(kind: int, row: dict) -> tuple:
    return kind, row["part"], row["doc_id"], row["n_chars"], None, row["fingerprint"], None, None, None, row["text"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(ROWS.values())], list(ROWS))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range, in order, against their next ones; the range's first and last also as they are."""
    held = None
    for b in batches:
        out = []
        for row in b.to_pylist():
            row["fingerprint"] = fingerprint(row["text"])
            out.append(_kept(FIRST, row) if held is None else _compared(held, row))
            held = row
        yield _batch(out)
    if held is not None:
        yield _batch([_kept(LAST, held)])


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([_compared(r, {"text": r["n_text"], "fingerprint": r["n_fingerprint"]}) for r in b.to_pylist()])


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and the next document by descending id:
    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("uid"),
                       F.length(text).cast("long").alias("n_chars"), text.cast("binary").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").asc(), F.col("uid").asc()]
    lined = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_chars", "text", F.spark_partition_id().alias("part"))
    walked = cut_lineage(map_texts(lined, _walk, ROWS_DDL), "ctph-walked")
    # a row a range: the ranges' numbers, and each one's successor, the first again after the last
    parts = sorted(r["part"] for r in walked.where(F.col("kind") == FIRST).select("part").collect())
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    done = walked.where(F.col("kind") == DONE).select(*names)
    if not parts:
        return done
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    first = walked.where(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("n_text"),
                                                        F.col("fingerprint").alias("n_fingerprint"))
    meet = walked.where(F.col("kind") == LAST).select("part", "doc_id", "n_chars", "fingerprint", "text").join(pairs, "part").join(first, "next_part")
    return done.unionByName(map_texts(meet, _meet, ROWS_DDL).select(*names))
