"""SimHash near-duplicates by vantage-point trees.

1. Fingerprint every text in one pass (``mapInArrow``, no shuffle).
2. Group equal fingerprints; only distinct ones go on.
3. Build a vantage-point tree on a bounded sample of distinct fingerprints
   (``SAMPLE`` at most, so the tree broadcast with the tasks has at most
   ``MAX_SHARDS`` leaves).  Its leaves are the shards: every fingerprint has one
   home, and visits each other shard that the triangle bounds leave open.  A
   pair across a boundary is found where its inner end is at home, so only
   points outside a vantage point's ball are sent into it.
4. In each shard a local vantage-point tree finds the exact pairs of homes and
   visitors.  Pairs are folded into a union-find as they are found; a shard
   emits a spanning forest, never its pairs.
5. Connected components of the forests (distributed), then the smallest id.

Defined results: a text without words (null and empty ones too) has the
fingerprint zero and links like any other; fewer words than a shingle make one
shingle; repeated rows give a row each; null ids stay and don't count for the
smallest id (a component of null ids only has none); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import components, cut_lineage, map_texts, row_key

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Distinct fingerprints in a shard, shards, and sampled fingerprints for a shard; the sample is at most MAX_SHARDS * PER_LEAF.
SHARD_SIZE, MAX_SHARDS, PER_LEAF = 32_768, 8192, 16
#: In a shard, nodes of so many homes are compared directly, in blocks of so many pairs.
LEAF, BLOCK_PAIRS = 256, 1 << 20


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles (A-Z lowered; words are parted by ASCII blanks)."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(size) - size
    digest = xxhash.xxh64_intdigest
    ends = (begin[width - 1:] + size[width - 1:] - 1).tolist()
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begin[:n].tolist(), ends, strict=True)), np.uint64, n)
    over = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 15):
        part = h[lo:lo + (1 << 15)]
        over += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp): one row for each document; fp is the fingerprint as a signed long."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2)
            fp = np.fromiter((fingerprint(texts[i].as_py(), width) for i in range(b.num_rows)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "row_key", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).cast("binary"))
    return map_texts(rows, run, "doc_id long, row_key long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """Vantage-point tree as arrays: node k has vantage[k], radius[k] and two
    children; a negative child -s-1 is shard s."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.shards = 0
        self.root = self._build(sample, max(1, shards), np.random.default_rng(SEED))

    def _build(self, points: np.ndarray, shards: int, rng) -> int:
        best = None
        if shards > 1 and len(points) > 1:
            for v in rng.choice(points, min(8, len(points)), replace=False):
                d = distance(points, v)
                r = int(np.median(d))
                if (d <= r).all():
                    r -= 1
                if (d <= r).any() and (best is None or d.var() > best[0]):
                    best = d.var(), v, r, d
        if best is None:
            self.shards += 1
            return -self.shards
        _, v, r, d = best
        k = len(self.vantage)
        self.vantage.append(int(v))
        self.radius.append(r)
        self.inside.append(0)
        self.outside.append(0)
        near = d <= r
        n_in = min(shards - 1, max(1, round(shards * near.mean())))
        self.inside[k] = self._build(points[near], n_in, rng)
        self.outside[k] = self._build(points[~near], shards - n_in, rng)
        return k

    def route(self, points: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, shard, at home?) of every place where a point has to be."""
        out: list[tuple] = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), np.bool_))]
        while todo:
            node, idx, home = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                out.append((idx, np.full(len(idx), -node - 1), home))
                continue
            d = distance(points[idx], np.uint64(self.vantage[node])).astype(np.int64)
            r = self.radius[node]
            near = d <= r
            # a home goes to its own side, and as a visitor into the ball if it is near it; a visitor goes wherever homes can be in reach
            go_in = d <= r + bits
            todo.append((self.inside[node], idx[go_in], (home & near)[go_in]))
            go_out = np.where(home, ~near, d > r - bits)
            todo.append((self.outside[node], idx[go_out], home[go_out]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union-find over 0..n-1, fed with arrays of pairs; the smaller index is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def _flat(self) -> None:
        while (nxt := self.up[self.up]).tobytes() != self.up.tobytes():
            self.up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.up[a], self.up[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))
            self._flat()


def forest(points: np.ndarray, homes: np.ndarray, bits: int) -> np.ndarray:
    """Root of every point, where pairs of a home and any other point at most ``bits`` apart are joined.

    ``points`` holds every home and visitor once; ``homes``: indices.
    """
    got = Forest(len(points))
    rng = np.random.default_rng(SEED)
    todo = [(homes, np.arange(len(points)))]
    while todo:
        own, seen = todo.pop()
        if not len(own) or not len(seen):
            continue
        if len(own) > LEAF:
            v = points[rng.choice(own)]
            d = distance(points[own], v).astype(np.int64)
            r = int(np.median(d))
            if (d <= r).all():
                r -= 1
            near = d <= r
            if near.any() and not near.all():
                e = distance(points[seen], v).astype(np.int64)
                todo.append((own[near], seen[e <= r + bits]))
                todo.append((own[~near], seen[e > r - bits]))
                continue
        step = max(1, BLOCK_PAIRS // len(seen))
        for lo in range(0, len(own), step):
            part = own[lo:lo + step]
            i, j = np.nonzero(distance(points[part][:, None], points[seen][None, :]) <= bits)
            i, j = part[i], seen[j]
            apart = i != j
            if apart.any():
                got.link(i[apart], j[apart])
    return got.up


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def links(fps: DataFrame, bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a, b): edges that join the distinct fingerprints ``fp`` of ``fps`` at most ``bits`` apart, as spanning forests."""
    spark = fps.sparkSession
    n = fps.count()
    shards = min(MAX_SHARDS, -(-n // shard_size)) or 1
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(PER_LEAF * shards)
    points = np.array([r.fp for r in sample.collect()], np.int64).view(np.uint64)
    tree = Tree(points, shards)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(own), 8192):
                part = own[lo:lo + 8192]
                idx, shard, home = tree.route(part, bits)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), _signed(part[idx]), pa.array(home)], ["shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(fp)
        fp, home = fp[order], home[order]
        up = forest(fp, np.flatnonzero(home), bits)
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": _signed(fp[moved]), "b": _signed(fp[up[moved]])})

    routed = fps.select("fp").mapInArrow(route, "shard int, fp long, home boolean")
    edges = routed.groupBy("shard").applyInArrow(search, "a long, b long")
    return cut_lineage(edges, "simhash-links") if n else spark.createDataFrame([], "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE,
                    bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row_key, fp, component_id, links): a row for each document; component_id is the
    smallest id among all documents reachable over fingerprints at most ``bits`` apart, root the
    component's own key."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, bits))
    # a left join on the distinct fingerprints: one row each on both sides
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = cut_lineage(named.join(least, "root").select("fp", "root", "component_id"), "simhash-components")
    return fps.join(ids, "fp", "left").select("doc_id", "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest (id, row key).

    Only keys are grouped.  Rows that go, and rows that occur more than once,
    are small tables beside the corpus, which the planner broadcasts or
    shuffles by their size; other rows pass without a shuffle.
    """
    near = cut_lineage(near_duplicates(docs, id_col, text_col, width, bits), "near-duplicates")
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row_key")
    groups = near.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    # what a group keeps is one row key, of as many equal rows as there are
    kept = groups.select(F.col("root").alias("of"), F.col("first.row_key").alias("kept"))
    gone = near.join(kept, near["root"] == kept["of"]).where("row_key <> kept").select(F.col("row_key").alias("__gone")).distinct()
    gone = cut_lineage(gone, "near-duplicates-gone")
    same = near.groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row_key").alias("__same"))
    same = cut_lineage(same, "repeated-rows")
    key = row_key(id_col, text_col)
    rest = docs.join(gone, key == F.col("__gone"), "left_anti")
    if same.isEmpty():
        return rest
    single = rest.join(same, key == F.col("__same"), "left_anti")
    repeated = rest.withColumn("__key", key).join(same, F.col("__key") == F.col("__same"), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["__key"]).drop("__key"))
