"""Conversation prefix tries as packed double arrays.

1. ``numbered``: turns get their place in their conversation and the key of the
   prefix that ends with them, a polynomial over 128-bit turn hashes.  Turns
   are sorted by ranges of (conversation, turn); a conversation may run over any
   number of ranges, whose sums are carried on from one row a range.  Texts
   leave the plan at once: all later steps see hashes and lengths only.
2. ``rebuild``: the first turns of a block's first conversation replace those of
   the others.  Conversations of equal turns form a class, of which the smallest id
   goes on; prefix keys of the others' turns aren't counted again.
3. Prefixes of one class only make up its tail and stay outside the arrays, as in
   double-array tries with tails: their aggregates follow from the class alone.
4. Classes that share prefixes go into shards by prefix: the shortest one under
   which at most ``LIMIT`` classes lie.  A shard packs BASE and CHECK over dense
   turn ids (``DoubleArray``), walks all its classes through them, and adds up the
   nodes from the leaves.  Prefixes of more classes are the upper nodes, shared by
   shards: their totals are aggregated from the shards' roots, level by level of
   their own paths.
5. Ids that end at a node are joined in blocks of ``2**BLOCK_BITS`` ids before they are
   streamed, in order, into one digest.

A shard holds the shared turns of its classes (some ten longs a turn), so two
different conversations that share a very long prefix are held by one task.

Defined results: null role or text is empty; turns of equal number follow the
order of their hashes, repeated rows count each; rows without a conversation id
belong to none and are left out; a block's first id is ``id - id % fold``, as SQL's
``%`` has it for negative ids; an empty table gives no rows (not even a root);
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage

FOLD, MOST = 100, 6
LIMIT = 256
SHARD_ROWS = 20_000
BLOCK_BITS = 12
#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WRAP = 1 << 64
_TRIES = 64


def _long(x: int) -> int:
    """An unsigned 64-bit number as a signed one."""
    x %= WRAP
    return x - WRAP if x >= WRAP >> 1 else x


def _u(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, x1, x2, chars): turns without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("x1"), F.xxhash64(F.lit(1), text, role).alias("x2"),
        F.length(text).cast("long").alias("chars")).where("conv_id is not null")


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range's turns: place, prefix keys and characters so far, counted from the range's begin."""
    conv, place, keys, so_far = None, 0, (0, 0), 0
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(0).to_numpy()
        new = np.concatenate(([True], c[1:] != c[:-1]))
        start = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        local = np.arange(len(c)) - start[own]
        if c[0] != conv:
            place, keys, so_far = 0, (0, 0), 0
        first = own == 0
        i = local + 1 + np.where(first, place, 0)
        out = []
        for lane in (0, 1):
            term = _u(b.column(1 + lane)) * _powers(BASES[lane], int(local.max()) + 2)[local + 1]
            term[first] *= np.uint64(pow(BASES[lane], place, WRAP))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(term)))
            got = sums[1:] - sums[start][own]
            got[first] += np.uint64(keys[lane])
            out.append(got)
        length = b.column(3).to_numpy()
        sums = np.concatenate(([0], np.cumsum(length)))
        cum = sums[1:] - sums[start][own] + np.where(first, so_far, 0)
        yield pa.RecordBatch.from_arrays(
            [b.column(4), b.column(0), pa.array(i), pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64)), pa.array(cum), *b.columns[1:4]],
            ["part", "conv_id", "i", "o1", "o2", "cum", "x1", "x2", "chars"])
        conv, place, keys, so_far = c[-1], int(i[-1]), (int(out[0][-1]), int(out[1][-1])), int(cum[-1])


NUMBERED = "part int, conv_id long, i long, o1 long, o2 long, cum long, x1 long, x2 long, chars long"


def numbered(turns: DataFrame) -> DataFrame:
    """(part, conv_id, i, o1, o2, cum, x1, x2, chars): every turn with its place (from 1), the key of the
    prefix that it ends, and that prefix's characters."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x1"), F.col("x2"), F.col("uid")]
    lined = narrow(turns).withColumn("uid", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = lined.select("conv_id", "x1", "x2", "chars", F.spark_partition_id().alias("part"))
    local = cut_lineage(rows.mapInArrow(_scan, NUMBERED), "trie-turns")
    last = F.struct("conv_id", "i")
    # a row a range
    ranges = local.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b"),
                                       *[F.max_by(c, last).alias(c) for c in ("i", "o1", "o2", "cum")]).orderBy("part").collect()
    carried: dict = {}
    before = (None, 0, 0, 0, 0)
    for r in ranges:
        conv, n, o1, o2, cum = before
        if r["a"] == conv:
            carried[r["part"]] = before
        if r["b"] == conv:  # the whole range belongs to a conversation that began before
            before = (conv, n + r["i"], *((o + r[c] * pow(b, n, WRAP)) % WRAP for o, c, b in zip((o1, o2), ("o1", "o2"), BASES, strict=True)), cum + r["cum"])
        else:
            before = (r["b"], r["i"], r["o1"] % WRAP, r["o2"] % WRAP, r["cum"])
    return local.mapInArrow(_carry(carried), NUMBERED) if carried else local


def _carry(carried: dict) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, conv, i, cum = (b.column(k).to_numpy().copy() for k in (0, 1, 2, 5))
            o = [_u(b.column(3)).copy(), _u(b.column(4)).copy()]
            for p in np.unique(part).tolist():
                if p in carried:
                    c, n, o1, o2, chars = carried[p]
                    at = (part == p) & (conv == c)
                    i[at] += n
                    cum[at] += chars
                    for lane, more in ((0, o1), (1, o2)):
                        o[lane][at] = o[lane][at] * np.uint64(pow(BASES[lane], n, WRAP)) + np.uint64(more)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(i), *(pa.array(x.view(np.int64)) for x in o), pa.array(cum), *b.columns[6:]],
                                             b.schema.names)

    return run


def kept_turns(most: int = MOST) -> Column:
    """How many turns a conversation takes from its block's first one."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % most


REBUILT = ("conv_id long, h long, hb long, n long, e1 long, e2 long, total long, s1 long, s2 long, oh1 long, oh2 long, cum0 long, "
           "head array<struct<i:long,x1:long,x2:long,chars:long,o1:long,o2:long,cum:long>>")


def _refold(batches) -> Iterator:
    """Of each conversation: how many turns it takes over, its length, and the key and characters of its whole sequence."""
    back = [pow(b, -1, WRAP) for b in BASES]
    for b in batches:
        out = []
        for r in b.to_pylist():
            head = sorted((r["head"] or [])[:], key=lambda x: x["i"])[:r["h"]]
            h, hb, own = r["h"], len(head), r["n_own"] > r["h"]
            base = [(head[-1][c] if hb else 0) for c in ("o1", "o2", "cum")]
            at_h = [r[c] if own and h else 0 for c in ("oh1", "oh2", "ch")]
            ends = [s + (r[c] - x) * pow(f, h - hb, WRAP) if own else s for s, c, x, f in zip(base, ("o1", "o2"), at_h, back)]
            out.append((r["conv_id"], h, hb, hb + (r["n_own"] - h if own else 0), *map(_long, ends), base[2] + (r["cum"] - at_h[2] if own else 0),
                        base[0], base[1], at_h[0], at_h[1], base[2] - at_h[2], head))
        names = [x.split()[0] for x in REBUILT.split(", ")]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("i", "x1", "x2", "chars", "o1", "o2", "cum")]))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind if n == "head" else pa.int64()) for k, n in enumerate(names)], names)


def rebuild(turns: DataFrame, fold: int = FOLD, most: int = MOST) -> DataFrame:
    """Of each conversation: ``REBUILT`` (e1, e2: key of its whole rebuilt sequence)."""
    h = kept_turns(most)
    own = turns.groupBy("conv_id").agg(
        F.max("i").alias("n_own"), *[F.max_by(c, "i").alias(c) for c in ("o1", "o2", "cum")],
        *[F.max(F.when(F.col("i") == h, F.col(c))).alias(a) for c, a in (("o1", "oh1"), ("o2", "oh2"), ("cum", "ch"))])
    # at most ``most - 1`` turns a block
    head = turns.where((F.col("conv_id") % fold == 0) & (F.col("i") < most)).groupBy(F.col("conv_id").alias("block")).agg(
        F.collect_list(F.struct("i", "x1", "x2", "chars", "o1", "o2", "cum")).alias("head"))
    both = own.withColumn("block", F.col("conv_id") - F.col("conv_id") % fold).join(head, "block", "left")
    return cut_lineage(both.withColumn("h", h.cast("long")).drop("block").mapInArrow(_refold, REBUILT), "trie-conversations")


ROWS = "c long, d long, p1 long, p2 long, x1 long, x2 long, chars long, cum long, m long, n long, total long"


def _shift(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns at their rebuilt depth, with the keys of the rebuilt prefixes."""
    back = [pow(b, -1, WRAP) for b in BASES]
    for b in batches:
        col = dict(zip(b.schema.names, b.columns, strict=True))
        h, hb = col["h"].to_numpy(), col["hb"].to_numpy()
        keys = []
        for lane, f in enumerate(back):
            power = _powers(f, MOST + int((h - hb).max(initial=0)) + 1)[h - hb]
            keys.append(_u(col[f"s{lane + 1}"]) + (_u(col[f"o{lane + 1}"]) - _u(col[f"oh{lane + 1}"])) * power)
        yield pa.RecordBatch.from_arrays(
            [col["conv_id"], pa.array(col["i"].to_numpy() - h + hb), *(pa.array(k.view(np.int64)) for k in keys), col["x1"], col["x2"], col["chars"],
             pa.array(col["cum"].to_numpy() + col["cum0"].to_numpy()), col["m"], col["n"], col["total"]], [x.split()[0] for x in ROWS.split(", ")])


def class_rows(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``ROWS``: every turn of each class's smallest conversation ``c``, with its depth and its prefix's key."""
    classes = convs.groupBy("n", "e1", "e2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("m")).select("conv_id", "m")
    reps = convs.join(classes, "conv_id")
    own = turns.select("conv_id", "i", "o1", "o2", "cum", "x1", "x2", "chars").join(reps.drop("head"), "conv_id").where("i > h").mapInArrow(_shift, ROWS)
    head = reps.select("conv_id", "m", "n", "total", F.explode("head").alias("t")).select(
        F.col("conv_id").alias("c"), F.col("t.i").alias("d"), F.col("t.o1").alias("p1"), F.col("t.o2").alias("p2"), "t.x1", "t.x2", "t.chars", "t.cum",
        "m", "n", "total")
    return cut_lineage(own.unionByName(head), "trie-rows")


class DoubleArray:
    """A trie over integer symbols: the child of state s by symbol a is t = BASE[s] + a, if CHECK[t] is s."""

    def __init__(self, words: list[list[int]]):
        """``words`` in any order; equal ones share their states."""
        words = sorted(words)
        self.base, self.check = [0], [-2]
        self._free = 1
        stack = [(0, len(words), 0, 0)]
        while stack:
            lo, hi, depth, state = stack.pop()
            while lo < hi and len(words[lo]) == depth:
                lo += 1
            if lo == hi:
                continue
            cuts = [lo, *(k for k in range(lo + 1, hi) if words[k][depth] != words[k - 1][depth]), hi]
            symbols = [words[k][depth] for k in cuts[:-1]]
            base = self._fit(symbols)
            self.base[state] = base
            for a in symbols:
                self.check[base + a] = state
            stack += [(x, y, depth + 1, base + a) for (x, y), a in zip(pairwise(cuts), symbols, strict=True)]

    def _fit(self, symbols: list[int]) -> int:
        """A base by which all these symbols fall on free places; symbols ascend."""
        check = self.check
        while self._free < len(check) and check[self._free] >= 0:
            self._free += 1
        at, tries = self._free, 0
        while tries < _TRIES and at < len(check):
            base = at - symbols[0]
            if check[at] < 0 and all(base + a >= len(check) or check[base + a] < 0 for a in symbols):
                break
            at += 1
            tries += 1
        else:
            at = len(check)
        base = at - symbols[0]
        more = base + symbols[-1] + 1 - len(check)
        if more > 0:
            self.check += [-1] * more
            self.base += [0] * more
        return base

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.base, np.int64), np.array(self.check, np.int64)


def dense(words: list[list]) -> list[list[int]]:
    """The words' symbols numbered by first appearance in sorted order, a level at a time, so that siblings are close."""
    words_at = sorted(range(len(words)), key=lambda k: words[k])
    number: dict = {}
    depth, active = 0, words_at
    while active := [k for k in active if len(words[k]) > depth]:
        for k in active:
            number.setdefault(words[k][depth], len(number))
        depth += 1
    return [[number[a] for a in w] for w in words]


NODES = ("kind int, conv_id long, depth long, parent_conv_id long, q1 long, q2 long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "end_conv long, end_n long")
_NAMES = [x.split()[0] for x in NODES.split(", ")]
NODE, STUB = 0, 1


def shard_nodes(table: pa.Table) -> pa.Table:
    """The nodes of a shard's classes (kind 0), and of classes with a tail the node above it (kind 1)."""
    rows = table.to_pylist()
    # a first turn counts together with what stands above it; deeper ones by themselves
    words = dense([[(0, r["path"][0]["p1"], r["path"][0]["p2"]), *((1, t["x1"], t["x2"]) for t in r["path"][1:])] for r in rows])
    base, check = DoubleArray(words).arrays()
    size = len(base)
    convs, leaves, saved, children, chars, depth = (np.zeros(size, np.int64) for _ in range(6))
    rep = np.full(size, np.iinfo(np.int64).max)
    end = np.full(size, -1)
    m, c = (np.array([r[k] for r in rows], np.int64) for k in ("m", "c"))
    state = np.zeros(len(rows), np.int64)
    long = np.array([len(w) for w in words])
    level, active = [], np.arange(len(rows))
    for j in range(int(long.max())):
        active = active[long[active] > j]
        to = base[state[active]] + np.array([words[k][j] for k in active])
        if (check[to] != state[active]).any():
            raise AssertionError("a packed word is not found")
        state[active] = to
        np.add.at(convs, to, m[active])
        np.minimum.at(rep, to, c[active])
        chars[to] = [rows[k]["path"][j]["chars"] for k in active]
        depth[to] = [rows[k]["path"][j]["d"] for k in active]
        level.append(np.unique(to))
    tail = np.array([r["n"] > r["path"][-1]["d"] for r in rows])
    np.add.at(children, state[tail], 1)
    np.add.at(leaves, state[tail], 1)
    np.add.at(saved, state[tail], np.array([r["tail"] for r in rows], np.int64)[tail])
    end[state[~tail]] = np.flatnonzero(~tail)
    for j in range(len(level) - 1, -1, -1):
        s = level[j]
        leaves[s] += children[s] == 0
        saved[s] += (convs[s] - 1) * chars[s]
        if j:
            for total, more in ((children, 1), (leaves, leaves[s]), (saved, saved[s])):
                np.add.at(total, check[s], more)
    above = {}
    for k, r in enumerate(rows):
        above[int(base[0] + words[k][0])] = (r["q1"], r["q2"])
    out = []
    for j, level_states in enumerate(level):
        for s in level_states.tolist():
            e = rows[end[s]] if end[s] >= 0 else {"c": None, "m": None}
            q = above[s] if j == 0 else (None, None)
            out.append((NODE, int(rep[s]), int(depth[s]), None if j == 0 else int(rep[check[s]]), *q, int(convs[s]), int(children[s]), int(leaves[s]),
                        int(saved[s]), e["c"], e["m"]))
    out += [(STUB, rows[k]["c"], rows[k]["path"][-1]["d"] + 1, int(rep[state[k]]), *[None] * 8) for k in np.flatnonzero(tail).tolist()]
    return pa.table([pa.array([o[k] for o in out], pa.int32() if n == "kind" else pa.int64()) for k, n in enumerate(_NAMES)], _NAMES)


def prefix_nodes(turns: DataFrame, fold: int = FOLD, most: int = MOST, limit: int = LIMIT) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): every node of the
    trie of the rebuilt conversations."""
    spark = turns.sparkSession
    placed = numbered(turns)
    convs = rebuild(placed, fold, most)
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("c")).first()
    if not whole["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                                         "saved_tokens long, ends_sha256 string")
    rows = class_rows(placed, convs)
    key = ["p1", "p2", "d"]
    groups = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("k"), F.min("c").alias("c"), F.sum("m").alias("m"), F.min("chars").alias("chars"),
                                                F.min("cum").alias("cum"), F.min("n").alias("n"), F.min("total").alias("total")), "trie-prefixes")
    shared = rows.join(groups.where("k > 1").select(*key, "k"), key)
    step = F.struct("d", "k", "x1", "x2", "chars", "p1", "p2")
    paths = shared.groupBy("c").agg(F.sort_array(F.collect_list(step)).alias("path"), F.min("m").alias("m"), F.min("n").alias("n"),
                                    (F.min("total") - F.max("cum")).alias("rest"))
    many = F.size(F.filter("path", lambda t: t["k"] > limit))
    paths = cut_lineage(paths.select("c", "m", "n", "path", ((F.col("m") - 1) * F.col("rest")).alias("tail"), many.alias("many")), "trie-paths")

    # shards of whole subtrees
    n_rows = paths.agg(F.sum(F.size("path") - F.col("many"))).first()[0] or 0
    n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SHARD_ROWS))
    below = paths.where(F.size("path") > F.col("many"))
    top = F.element_at("path", F.col("many") + 1)
    over = F.when(F.col("many") > 0, F.get("path", F.col("many") - 1))
    below = below.select("c", "m", "n", "tail", F.expr("slice(path, many + 1, size(path) - many)").alias("path"), over["p1"].alias("q1"),
                         over["p2"].alias("q2"), F.pmod(F.xxhash64(top["p1"], top["p2"]), F.lit(n_shards)).alias("shard"))
    got = cut_lineage(below.groupBy("shard").applyInArrow(shard_nodes, NODES), "trie-shards")
    inner = got.where(F.col("kind") == NODE)

    upper, upper_stubs = _upper(paths, inner, limit)

    # tails: nodes of one class
    stubs = got.where(F.col("kind") == STUB).select("conv_id", "depth", "parent_conv_id").unionByName(upper_stubs)
    tails = groups.where("k = 1").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("m").alias("n_convs"), (F.col("d") < F.col("n")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("m") - 1) * (F.col("total") - F.col("cum") + F.col("chars"))).alias("saved_tokens"),
        F.when(F.col("d") == F.col("n"), F.col("c")).alias("end_conv"), F.when(F.col("d") == F.col("n"), F.col("m")).alias("end_n"))
    root_id = F.lit(whole["c"])
    tails = tails.join(stubs, ["conv_id", "depth"], "left").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, root_id).otherwise(F.coalesce("parent_conv_id", "conv_id")))

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "end_n"]
    inner = inner.where(F.col("q1").isNull()).withColumn("parent_conv_id", F.when(F.col("depth") == 1, root_id).otherwise(F.col("parent_conv_id"))).select(
        *names).unionByName(_under(inner, upper).select(*names))
    upper = upper.withColumn("parent_conv_id", F.when(F.col("depth") == 1, root_id).otherwise(F.col("parent_conv_id")))
    nodes = cut_lineage(tails.select(*names).unionByName(inner).unionByName(upper.select(*names)), "trie-nodes")
    bare = convs.where("n = 0").agg(F.min("conv_id").alias("c"), F.count("*").alias("n")).first()  # conversations without turns
    root = nodes.where("depth = 1").agg(
        F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens")).select(
        root_id.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(whole["n"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.lit(bare["c"]).cast("long").alias("end_conv"), F.lit(bare["n"]).cast("long").alias("end_n"))
    return _with_ends(nodes.unionByName(root), convs)


def _upper(paths: DataFrame, inner: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes of more than ``limit`` classes as nodes, from what lies below them; and of
    classes whose tails hang from them (conv_id, depth, parent_conv_id)."""
    far = paths.where("many > 0")
    level = far.select("c", "m", F.posexplode(F.expr("slice(path, 1, many)")).alias("at", "t"), "path").select(
        "c", "m", "t.p1", "t.p2", "t.d", "t.chars", F.when(F.col("at") > 0, F.get("path", F.col("at") - 1)["p1"]).alias("q1"),
        F.when(F.col("at") > 0, F.get("path", F.col("at") - 1)["p2"]).alias("q2"))
    own = cut_lineage(level.groupBy("p1", "p2", "d").agg(
        F.sum("m").alias("n_convs"), F.min("c").alias("conv_id"), F.min("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2")), "trie-upper")
    # what hangs from an upper node itself: shards' roots, tails, other upper nodes
    last = F.element_at("path", F.col("many"))
    hung = far.where("many = size(path)").select("c", "m", "n", "tail", last["p1"].alias("p1"), last["p2"].alias("p2"), last["d"].alias("d"))
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    kids = inner.where(F.col("q1").isNotNull()).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("d"), one.alias("kids"),
                                                      F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    kids = kids.unionByName(hung.where("n > d").select("p1", "p2", "d", one.alias("kids"), one.alias("leaves"), F.col("tail").alias("saved")))
    kids = kids.unionByName(own.where(F.col("q1").isNotNull()).select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("d") - 1).alias("d"),
                                                                      one.alias("kids"), zero.alias("leaves"), zero.alias("saved")))
    direct = kids.groupBy("p1", "p2", "d").agg(F.sum("kids").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    key = ["p1", "p2", "d"]
    ends = hung.where("n = d").select(*key, F.col("c").alias("end_conv"), F.col("m").alias("end_n"))
    own = own.join(direct, key).join(ends, key, "left")  # every upper node has children
    # each upper node counts for itself and all above it, which stand on its smallest class's path
    up = own.select("conv_id", F.col("d").alias("own_d"), "leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")).join(
        far.select(F.col("c").alias("conv_id"), "path"), "conv_id")
    up = up.select("leaves", "saved", F.explode(F.expr("slice(path, 1, own_d)")).alias("t")).groupBy(
        F.col("t.p1").alias("p1"), F.col("t.p2").alias("p2"), F.col("t.d").alias("d")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = own.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(own.drop("leaves", "saved").join(up, key).join(parents, ["q1", "q2"], "left").select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_conv", "end_n", "p1", "p2"),
        "trie-upper-nodes")
    stubs = hung.where("n > d").join(nodes.select("p1", "p2", F.col("conv_id").alias("parent_conv_id")), ["p1", "p2"]).select(
        F.col("c").alias("conv_id"), (F.col("d") + 1).alias("depth"), "parent_conv_id")
    return nodes, stubs


def _under(inner: DataFrame, upper: DataFrame) -> DataFrame:
    """Shards' roots that hang from upper nodes, with these as parents."""
    ids = upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above"))
    return inner.where(F.col("q1").isNotNull()).join(ids, ["q1", "q2"]).withColumn("parent_conv_id", F.col("above"))


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's id blocks, which come sorted, as one stream."""
    now, sha, done = None, None, []
    for b in batches:
        for c, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = c, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["end_conv", "digest"])
        done = []
    if sha is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])], ["end_conv", "digest"])


def _with_ends(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes with the digest of the ids that end there."""
    key = ["n", "e1", "e2"]
    copies = convs.groupBy(*key).agg(F.min("conv_id").alias("end_conv"), F.count("*").alias("copies")).where("copies > 1")
    members = convs.select("conv_id", *key).join(copies, key)
    # blocks of successive ids first, so that the last step reads few rows of a large class
    blocks = members.groupBy("end_conv", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    streamed = blocks.repartition("end_conv").sortWithinPartitions("end_conv", "block").select("end_conv", "ids").mapInArrow(
        _digest, "end_conv long, digest string")
    none = F.sha2(F.lit("").cast("binary"), 256)
    one = F.when(F.coalesce("end_n", F.lit(0)) == 0, none).otherwise(F.sha2(F.col("end_conv").cast("string").cast("binary"), 256))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    plain = nodes.where("coalesce(end_n, 0) < 2").withColumn("ends_sha256", one).select(*names)
    return plain.unionByName(nodes.where("end_n > 1").join(streamed, "end_conv").withColumn("ends_sha256", F.col("digest")).select(*names))


def oracle() -> str:
    """DuckDB SQL of the nodes, from whole lists of turns."""
    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, "text") AS i,
    {{'r': coalesce(role, ''), 't': coalesce("text", '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list(x ORDER BY i) AS w FROM t GROUP BY conv_id),
crc AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda v, k:
    CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256)),
table_ AS (SELECT list(v ORDER BY b) AS v FROM crc),
h AS (SELECT conv_id, w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda v, c: xor(v >> 8, table_.v[(xor(v, c) & 255) + 1])), 4294967295) % {MOST} AS h FROM s, table_),
r AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS w FROM h LEFT JOIN s b ON b.conv_id = h.conv_id - h.conv_id % {FOLD}),
d AS (SELECT conv_id, len(w) AS n, w, unnest(range(0, len(w) + 1)) AS d FROM r),
p AS (SELECT conv_id, n, d, md5(to_json(w[1:d])::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(to_json(w[1:d - 1])::VARCHAR) END AS above,
    CASE WHEN d > 0 THEN length(w[d].t) ELSE 0 END AS chars FROM d),
g AS (SELECT k, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, max(n) AS longest,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY k, d),
leaf AS (SELECT conv_id, d FROM g WHERE longest = d),
weight AS (SELECT conv_id, d, (n_convs - 1) * chars AS w FROM g),
under AS (SELECT p.k, p.d, sum(l.n) AS n_leaves, sum(u.w) AS saved FROM p
    LEFT JOIN (SELECT conv_id, count(*) AS n FROM leaf GROUP BY conv_id) l USING (conv_id)
    LEFT JOIN LATERAL (SELECT sum(w) AS w FROM weight WHERE weight.conv_id = p.conv_id AND weight.d >= p.d) u ON true GROUP BY p.k, p.d),
kids AS (SELECT above AS k, d - 1 AS d, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children,
    CAST(under.n_leaves AS BIGINT) AS n_leaves, CAST(coalesce(under.saved, 0) AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN under ON under.k = g.k AND under.d = g.d LEFT JOIN kids ON kids.k = g.k AND kids.d = g.d
LEFT JOIN g up ON up.k = g.above AND up.d = g.d - 1"""
