"""Gradient-boosted trees from gradient histograms.

* Values are cut into bins at exact quantiles, once; missing values keep a bin of
  their own.  The matrix is written as blocks (one byte a value) with label,
  weight and margin, so every pass reads a fraction of the rows' size.
* A tree grows level by level, a job a level.  One pass over the blocks gives, for
  open nodes, each feature and bin, the sums of gradients and hessians and the row
  count.  Of two children only the smaller one is counted: the other's sums are the
  rest of their parent's.  Features of few bins are counted together by all their
  bins, and told apart afterwards.  Where all tasks' sums of a level have at most
  ``driver_bytes``, the driver adds them up and finds the best splits; else tasks
  send each group of features its sums, which stay with the group for the next
  level, and only the best split a node and group reaches the driver.  The pass for
  a tree's root also gives the round's sums and the validation loss.  Features of
  one bin can't split and are not counted.
* A split sends missing values to the side that gains more (the learned default
  side), so undefined features need no filling.  Gains and leaf values carry L1
  and L2 penalties; leaves, rows a leaf, feature and row sampling are bounded by
  parameters.  Training stops when the validation rows' log loss has not
  improved for ``patience`` rounds.
* Blocks are dealt evenly over the cores and kept there (in memory, then on disk).
  Margins travel with them and are made anew from all trees every ``keep`` rounds;
  a task replays the trees since then.  The blocks are plain files too, so a lost
  executor costs the tasks it ran.

A matrix of at most ``local_rows`` rows is trained by one task with the same
functions, each feature counted by itself: there, passes would cost more than
their work.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import catalog as K
from ..session import cut_lineage
from .profile import exact_quantiles

#: The bin of missing values.
MISSING = 255
STATS = 3  # gradients, hessians, rows


@dataclass
class BoostParams:
    """Parameters of the boosted trees (M9 searches all but the first two and the last five)."""
    rounds: int = 100
    patience: int = 20
    learning_rate: float = 0.1
    max_depth: int = 5
    max_leaves: int = 31
    min_rows: int = 50
    feature_fraction: float = 0.8
    bagging_fraction: float = 0.8
    bagging_freq: int = 1
    l1: float = 0.1
    l2: float = 0.1
    bins: int = 64
    seed: int = K.RANDOM_STATE
    keep: int = 8
    local_rows: int = 50_000
    driver_bytes: int = 64 << 20


@dataclass
class Tree:
    """Node arrays; a node with ``left`` -1 is a leaf.  ``cut`` is the last bin that goes left, ``thr`` its
    upper edge, ``missing_left`` the side of missing values, ``cover`` the training rows below."""
    feat: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    thr: list = field(default_factory=list)
    missing_left: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)
    cover: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feat", -1), ("cut", -1), ("thr", 0.0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("cover", cover),
                        ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feat) - 1

    def nodes_of(self, go_left: Callable[[int], np.ndarray], n: int) -> np.ndarray:
        """The node that each of n rows ends in; ``go_left(node)`` tells of every row whether it would go left there.
        (Comparing whole columns and combining the answers as bits takes a fraction of picking each node's rows.)"""
        kind = np.int16 if len(self.feat) < 1 << 15 else np.int32
        at = np.zeros(n, kind)
        reach: dict[int, np.ndarray] = {0: np.ones(n, np.bool_)}
        for node, left in enumerate(self.left):  # a node stands before its children
            here = reach.pop(node)
            if left < 0:
                if node:
                    at += here * kind(node)
                continue
            reach[left] = here & go_left(node)
            reach[self.right[node]] = here ^ reach[left]
        return at

    def by_bins(self, bins: np.ndarray) -> np.ndarray:
        """Nodes of rows given as (features, rows) bins."""
        def go(node):
            b = bins[self.feat[node]]
            return (b <= self.cut[node]) | (b == MISSING) if self.missing_left[node] else b <= self.cut[node]
        return self.nodes_of(go, bins.shape[1])

    def by_values(self, x: np.ndarray) -> np.ndarray:
        """Nodes of rows given as (rows, features) values, NaN where missing."""
        def go(node):
            v = x[:, self.feat[node]]
            return ~(v > self.thr[node]) if self.missing_left[node] else v <= self.thr[node]
        return self.nodes_of(go, x.shape[0])


# ------------------------------------------------------------------ kernels
def soft(g, l1: float):
    """The gradient sum less the L1 penalty."""
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def worth(g, h, p: BoostParams):
    """What a node's sums are worth: T(G)^2 / (H + l2)."""
    return soft(g, p.l1) ** 2 / np.maximum(h + p.l2, 1e-16)


def leaf_value(g: float, h: float, p: BoostParams) -> float:
    return float(-p.learning_rate * soft(g, p.l1) / max(h + p.l2, 1e-16))


def gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the weighted log loss."""
    q = 1 / (1 + np.exp(-margin))
    return w * (q - y), w * q * (1 - q)


def log_loss(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(weighted sum, weights) of the log loss."""
    return float((w * (np.logaddexp(0, margin) - y * margin)).sum()), float(w.sum())


class Layout:
    """Where the sums of some features stand in a row of sums: a place a bin, and one for missing values after these."""

    def __init__(self, packs: list[list[int]], edges: list[np.ndarray], missing: list[bool] | None = None, features: list[int] | None = None):
        """``packs``: features in groups counted together. ``missing``: which of all features have missing values (not given: any may).
        ``features``: those whose sums are asked for (not given: all of the packs')."""
        every = sorted(f for pack in packs for f in pack)
        self.features = every if features is None else features
        self.packs = packs
        self.size = {f: len(edges[f]) + 2 for f in every}
        # places that occur
        self.radix = {f: n if missing is None or missing[f] else n - 1 for f, n in self.size.items()}
        self.width = 0
        self.start = {}
        for f in self.features:
            self.start[f] = self.width
            self.width += self.size[f]
        # features of about as many bins are searched together; their sums are filled up with zeros (the place after the last one)
        self.alike: list[tuple[list[int], np.ndarray]] = []
        wide, left = 4, set(range(len(self.features)))
        while left:
            some = sorted(k for k in left if self.size[self.features[k]] - 1 <= wide)
            if some:
                bins = max(self.size[self.features[k]] for k in some) - 1
                at = np.full((len(some), bins + 1), self.width)
                for i, k in enumerate(some):
                    start, n = self.start[self.features[k]], self.size[self.features[k]]
                    at[i, :n - 1] = np.arange(start, start + n - 1)
                    at[i, -1] = start + n - 1
                self.alike.append((some, at))
            left -= set(some)
            wide *= 2

    def code(self, pack: list[int], column: Callable[[int], np.ndarray]) -> np.ndarray:
        """The places of the pack's features as one number; ``column`` gives a feature's bins."""
        out = None
        for f in pack:
            place = np.minimum(column(f), np.uint8(self.size[f] - 1))  # missing values stand last
            if out is None:
                out = place.astype(np.uint16)
            else:
                out *= np.uint16(self.radix[f])
                out += place
        return out


def packed(features: list[int], radix: list[int] | dict[int, int], most: int) -> list[list[int]]:
    """Features in groups of which all values combined are at most ``most`` (or of one feature)."""
    out: list[list[int]] = []
    cells = most + 1
    for f in sorted(features, key=lambda f: (radix[f], f)):
        if cells * radix[f] > most:
            out.append([])
            cells = 1
        out[-1].append(f)
        cells *= radix[f]
    return out


#: Rows counted at a time, and the most sums of features counted together (a part of a core's cache).
COUNTED, JOINT = 1 << 16, 4096


def histogram(column: Callable[[int], np.ndarray], slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, lay: Layout,
              code: Callable[[int], np.ndarray] | None = None) -> np.ndarray:
    """(slots, STATS, places) sums of rows, each in a slot. ``column`` gives the rows' bins of a feature, ``code`` (if there are such) their
    codes of a pack. Packs are parted where the rows are few, so that sums never outnumber them."""
    out = np.zeros((slots, STATS, lay.width))
    if not len(slot):
        return out
    base = slot.astype(np.intp)
    most = min(JOINT, len(slot) // (2 * slots))
    for number, pack in enumerate(lay.packs):
        if code is not None and math.prod(lay.radix[f] for f in pack) <= most:
            parts = [(pack, code(number))]
        else:
            parts = [(part, lay.code(part, column)) for part in packed([f for f in pack if f in lay.start], lay.radix, most)]
        for part, codes in parts:
            some = [(axis, f) for axis, f in enumerate(part, 1) if f in lay.start]
            if not some:
                continue
            cells = math.prod(lay.radix[f] for f in part)
            at = base * cells + codes if slots > 1 else codes.astype(np.intp)
            for stat, sums in enumerate((np.bincount(at, g, cells * slots), np.bincount(at, h, cells * slots), np.bincount(at, minlength=cells * slots))):
                cube = sums.reshape(slots, *(lay.radix[f] for f in part))
                for axis, f in some:
                    out[:, stat, lay.start[f]:lay.start[f] + lay.radix[f]] = cube.sum(axis=tuple(x for x in range(1, cube.ndim) if x != axis))
    return out


def completed(level: dict[int, np.ndarray], counted: list[int], rest: dict[int, tuple[int, int]], sums: np.ndarray) -> dict[int, np.ndarray]:
    """A level's sums by node from those ``counted``, and from the ``level`` above for the others."""
    now = dict(zip(counted, sums, strict=True))
    for node, (above, other) in rest.items():
        now[node] = level[above] - now[other]
        now[node][:2, now[node][2] == 0] = 0.0  # nothing is left of an empty bin
    return now


def near_by(gain, g, h, p: BoostParams):
    """How much rounding may part equal gains of a node with these sums."""
    return 1e-11 * (np.where(np.isfinite(gain), gain, 0.0) + worth(g, h, p))


def best_of(sums: np.ndarray, lay: Layout, p: BoostParams, rounded: bool = True) -> list[dict | None]:
    """Of each slot's (STATS, places) sums the best split among the features, the first of equals. ``rounded``: sums were added up
    feature by feature in different orders, so gains within rounding are equal."""
    slots = len(sums)
    if not lay.features:
        return [None] * slots
    filled = np.concatenate((sums, np.zeros((slots, STATS, 1))), axis=2)
    gain = np.empty((slots, len(lay.features)))
    found = {}
    for some, at in lay.alike:
        got = best_splits(filled[:, :, at].transpose(0, 2, 1, 3).reshape(-1, STATS, at.shape[1]), p)
        gain[:, some] = got["gain"].reshape(slots, len(some))
        found.update({k: (got, i, len(some)) for i, k in enumerate(some)})
    least = gain.max(axis=1)
    if rounded:
        a = lay.start[lay.features[0]]
        g, h = sums[:, :2, a:a + lay.size[lay.features[0]]].sum(axis=2).T  # any feature's sums are the node's
        least = least - near_by(least, g, h, p)
    out: list[dict | None] = []
    for slot, k in enumerate(np.argmax(gain >= least[:, None], axis=1).tolist()):
        got, i, n = found[k]
        out.append({**{c: x[slot * n + i].item() for c, x in got.items()}, "f": lay.features[k]} if np.isfinite(gain[slot, k]) else None)
    return out


def best_splits(sums: np.ndarray, p: BoostParams) -> dict[str, np.ndarray]:
    """Of (m, STATS, bins + 1) sums, the best split of each: gain (-inf if none), cut, missing_left, sums of both sides.
    Among equal gains the lowest cut is best, and missing values go right."""
    m = len(sums)
    known, none = np.cumsum(sums[:, :, :-1], axis=2), sums[:, :, -1]
    total = known[:, :, -1] + none
    parent = worth(total[:, 0], total[:, 1], p)
    best = np.full(m, -np.inf)
    cut, side = np.zeros(m, np.int64), np.zeros(m, np.bool_)
    some = np.flatnonzero(none[:, 2] > 0)
    # all pairs with missing values on the right, then those that have any with these on the left
    for rows, left, missing_left in ((np.arange(m), known, False), (some, known[some] + none[some][:, :, None], True)):
        if not len(rows):
            continue
        right = total[rows][:, :, None] - left
        ok = (left[:, 2] >= p.min_rows) & (right[:, 2] >= p.min_rows) & (left[:, 1] > 1e-3) & (right[:, 1] > 1e-3)
        gain = np.where(ok, worth(left[:, 0], left[:, 1], p) + worth(right[:, 0], right[:, 1], p) - parent[rows][:, None], -np.inf)
        k = np.argmax(gain, axis=1)
        top = gain[np.arange(len(rows)), k]
        better = top > best[rows]
        best[rows[better]], cut[rows[better]], side[rows[better]] = top[better], k[better], missing_left
    at = np.arange(m)
    left = known[at, :, cut] + np.where(side[:, None], none, 0.0)
    right = total - left
    # where none is missing, those to come follow the larger side
    side = np.where(none[:, 2] == 0, left[:, 2] >= right[:, 2], side)
    return {"gain": best, "cut": cut, "missing_left": side, **{f"l{k}": left[:, k] for k in range(STATS)}, **{f"r{k}": right[:, k] for k in range(STATS)}}


def bagged(p: BoostParams, round_: int, block: int, n: int) -> np.ndarray:
    """Which rows of a block a round trains on; the same on every run."""
    if p.bagging_fraction >= 1:
        return np.ones(n, np.bool_)
    rng = np.random.default_rng([p.seed, round_ // max(p.bagging_freq, 1), block])
    return rng.random(n) < p.bagging_fraction


def round_features(p: BoostParams, round_: int, n: int) -> list[int]:
    k = max(1, round(p.feature_fraction * n))
    return sorted(np.random.default_rng([p.seed, 7, round_]).permutation(n)[:k].tolist())


class Growing:
    """A tree in the making: open nodes, and the splits that a pass found for them."""

    def __init__(self, p: BoostParams, edges: list[np.ndarray]):
        self.p, self.edges = p, edges
        self.tree = Tree()
        self.open: list[int] = []
        self.depth = 0

    def begin(self, sums: np.ndarray) -> None:
        self.tree.add(leaf_value(sums[0], sums[1], self.p), float(sums[2]))
        self.open = [0]

    def total(self, sums: np.ndarray) -> None:
        """The root's sums, where they are known only after its pass."""
        self.tree.value[0], self.tree.cover[0] = leaf_value(sums[0], sums[1], self.p), float(sums[2])

    def slots(self, at: np.ndarray, among: list[int] | None = None) -> np.ndarray:
        """Of the rows' nodes, the places among the open ones or those given (-1: none)."""
        among = self.open if among is None else among
        place = np.full(len(self.tree.feat), -1, np.int32)
        place[among] = np.arange(len(among))
        return place[at]

    def halves(self, known: dict) -> tuple[list[int], dict[int, tuple[int, int]]]:
        """The open nodes whose rows are to be counted, and those that are the rest of a ``known`` node: {node: (node above, its other child)}."""
        t, rest = self.tree, {}
        for node in known:
            a, b = t.left[node], t.right[node]
            if a in self.open and b in self.open:
                big, small = (a, b) if t.cover[a] >= t.cover[b] else (b, a)
                rest[big] = node, small
        return [n for n in self.open if n not in rest], rest

    def split(self, best: list[dict | None]) -> None:
        """Split the open nodes (best gains first, as far as leaves allow); children that may split are open next."""
        t = self.tree
        leaves = sum(1 for x in t.left if x < 0)
        order = sorted((k for k, b in enumerate(best) if b is not None and b["gain"] > 1e-12), key=lambda k: (-best[k]["gain"], k))
        opened = []
        for k in order[:max(self.p.max_leaves - leaves, 0)]:
            node, b = self.open[k], best[k]
            t.feat[node], t.cut[node], t.missing_left[node], t.gain[node] = int(b["f"]), int(b["cut"]), bool(b["missing_left"]), float(b["gain"])
            e = self.edges[t.feat[node]]
            t.thr[node] = float(e[t.cut[node]]) if t.cut[node] < len(e) else float("inf")
            t.left[node] = t.add(leaf_value(b["l0"], b["l1"], self.p), float(b["l2"]))
            t.right[node] = t.add(leaf_value(b["r0"], b["r1"], self.p), float(b["r2"]))
            opened += [t.left[node], t.right[node]]
        self.depth += 1
        more = self.depth < self.p.max_depth and len([x for x in t.left if x < 0]) < self.p.max_leaves
        self.open = sorted(n for n in opened if t.cover[n] >= 2 * self.p.min_rows) if more else []


# -------------------------------------------------------------------- model
@dataclass
class BoostModel:
    features: list[str]
    init: float
    trees: list[Tree]
    params: BoostParams
    history: list[float] = field(default_factory=list)   # validation log loss after each round

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Of (rows, features) values."""
        out = np.full(len(x), self.init)
        for t in self.trees:
            out += np.array(t.value)[t.by_values(x)]
        return out

    def scored(self, df: DataFrame, keep: list[str], out: str = "p") -> DataFrame:
        """``keep``, the margin and the probability of each row; columns are read as doubles, NULL is missing."""
        bc = df.sparkSession.sparkContext.broadcast(self)  # bounded by rounds x leaves
        keep = [k for k in keep if k in df.columns]
        d = len(keep)
        x = df.select(*keep, *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(self.features)])

        def run(batches):
            model = bc.value
            for b in batches:
                m = model.margin(matrix(b, d))
                yield pa.RecordBatch.from_arrays([*b.columns[:d], pa.array(m), pa.array(1 / (1 + np.exp(-m)))], [*keep, "margin", out])

        schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "margin double", f"{out} double"])
        return x.mapInArrow(run, schema)

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "init": self.init, "params": asdict(self.params), "history": self.history,
                           "trees": [asdict(t) for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostModel:
        d = json.loads(text)
        return cls(d["features"], d["init"], [Tree(**t) for t in d["trees"]], BoostParams(**d["params"]), d["history"])

    def importance(self) -> dict[str, float]:
        """Total gain by feature."""
        out = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feat, t.gain, strict=True):
                if f >= 0:
                    out[self.features[f]] += g
        return out


def matrix(batch: pa.RecordBatch, first: int = 0) -> np.ndarray:
    """The batch's columns from ``first`` on as (rows, columns) doubles, NaN where null."""
    cols = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[first:]]
    return np.stack(cols).T if cols else np.zeros((batch.num_rows, 0))  # a column is read at a time


# ------------------------------------------------------------------- blocks
def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Inner edges of each feature's bins: distinct exact quantiles (none for a feature without values or of one value)."""
    if not 2 <= bins < MISSING:
        raise ValueError(f"bins must be between 2 and {MISSING - 1}")
    probs = [i / bins for i in range(1, bins)]
    found = exact_quantiles(df, features, [0.0, *probs, 1.0])
    out = []
    for f in features:
        if (f, 0) not in found:
            out.append(np.zeros(0))
            continue
        top = found[f, bins]
        out.append(np.unique([v for i in range(1, bins) if (v := found[f, i]) < top]))
    return out


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(rows, features) values as (features, rows) bins: bin k holds values above edge k - 1 up to edge k."""
    out = np.empty((x.shape[1], x.shape[0]), np.uint8)
    for f, e in enumerate(edges):
        v = x[:, f]
        out[f] = np.where(np.isnan(v), MISSING, np.searchsorted(e, v, "left"))
    return out


BLOCKS = "block long, n int, y binary, w binary, val binary, bins binary, margin binary"
_BLOCK = [("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in ("y", "w", "val", "bins", "margin"))]


def _block_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_BLOCK)], [n for n, _ in _BLOCK])


def _unpacked(row: dict, d: int) -> tuple:
    """(bins, y, w, val, margin) of a block's row."""
    n = row["n"]
    return (np.frombuffer(row["bins"], np.uint8).reshape(d, n), np.frombuffer(row["y"], np.float32).astype(float),
            np.frombuffer(row["w"], np.float64), np.frombuffer(row["val"], np.bool_), np.frombuffer(row["margin"], np.float64))


def to_blocks(df: DataFrame, features: list[str], edges: list[np.ndarray], label: str, weight: str | None, val: str | None) -> DataFrame:
    """The matrix as binned blocks of an Arrow batch each, with zero margins.  Rows without a label are left out."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    v = F.coalesce(F.col(val).cast("boolean"), F.lit(False)) if val else F.lit(False)
    x = df.where(F.col(label).isNotNull()).select(
        F.spark_partition_id().cast("long").alias("part"), F.col(label).cast("float").alias("y"), w.alias("w"), v.alias("val"),
        *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(features)])

    def run(batches):
        for seq, b in enumerate(batches):
            if not b.num_rows:
                continue
            y, w, v = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            yield _block_batch([((b.column(0)[0].as_py() << 32) + seq, b.num_rows, y.astype(np.float32).tobytes(), w.astype(float).tobytes(),
                                 v.astype(np.bool_).tobytes(), to_bins(matrix(b, 4), edges).tobytes(), np.zeros(b.num_rows).tobytes())])

    return cut_lineage(x.mapInArrow(run, BLOCKS), "boost-blocks")


# ----------------------------------------------------------------- training
def binned(df: DataFrame, features: list[str], params: BoostParams | None = None, label: str = "TARGET", weight: str | None = "weight",
           val: str | None = "is_val") -> tuple[list[np.ndarray], DataFrame]:
    """The edges of the bins, from the rows without ``val``, and the matrix of all rows as written blocks."""
    train = df.where(~F.coalesce(F.col(val).cast("boolean"), F.lit(False))) if val else df
    edges = bin_edges(train.where(F.col(label).isNotNull()), features, (params or BoostParams()).bins)
    return edges, to_blocks(df, features, edges, label, weight, val)


def fit(df: DataFrame, features: list[str], params: BoostParams | None = None, label: str = "TARGET", weight: str | None = "weight",
        val: str | None = "is_val") -> BoostModel:
    """Train on the rows without ``val``; those with it stop the training early."""
    p = params or BoostParams()
    edges, blocks = binned(df, features, p, label, weight, val)
    return fit_blocks(blocks, features, edges, p)


def fit_blocks(blocks: DataFrame, features: list[str], edges: list[np.ndarray], p: BoostParams) -> BoostModel:
    """Train on a written matrix of blocks."""
    rows = rows_of(blocks)
    if rows <= p.local_rows:
        got = blocks.coalesce(1).mapInArrow(_local(features, edges, p), "model string").first()
        return BoostModel.from_json(got["model"]) if got else BoostModel(features, 0.0, [], p)
    return _distributed(blocks, features, edges, p)


def rows_of(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n")).first()[0] or 0


def start_margin(pos: float, weights: float) -> float:
    """The log odds of the weighted label mean."""
    if weights <= 0:
        return 0.0
    mean = min(max(pos / weights, 1e-6), 1 - 1e-6)
    return float(np.log(mean / (1 - mean)))


class Stopper:
    """Early stopping on the validation loss: keeps the best round."""

    def __init__(self, patience: int):
        self.patience, self.losses, self.best = patience, [], 0

    def add(self, loss: float | None) -> bool:
        """After a round; True: stop."""
        if loss is None:
            return False
        self.losses.append(loss)
        if loss < self.losses[self.best] - 1e-12:
            self.best = len(self.losses) - 1
        return len(self.losses) - 1 - self.best >= self.patience

    def kept(self, trees: list) -> list:
        return trees[:self.best + 1] if self.losses else trees


def train_arrays(parts: list[tuple], features: list[str], edges: list[np.ndarray], p: BoostParams, together: bool = True) -> BoostModel:
    """The training over arrays in memory: ``parts`` are (block, bins, y, w, val). Without ``together`` each feature is counted by itself,
    block by block, and gains are compared to the last bit."""
    blocks = [(b, len(y)) for b, _, y, _, _ in parts]
    ends = [0, *np.cumsum([n for _, n in blocks]).tolist()]
    bins, y, w, val = (np.concatenate([x[k] for x in parts], axis=-1) for k in (1, 2, 3, 4))
    parts = []  # held once
    learn = ~val

    def total(x: np.ndarray, rows: np.ndarray) -> float:
        return sum(float(x[a:b][rows[a:b]].sum()) for a, b in itertools.pairwise(ends))

    init = start_margin(total(w * y, learn), total(w, learn))
    margin = np.full(len(y), init)
    low, high = ([f(b) for b in bins] if len(y) else [0] * len(bins) for f in (np.min, np.max))
    missing = [x == MISSING for x in high]
    radix = [len(e) + 1 + m for e, m in zip(edges, missing, strict=True)]
    packs = packed([f for f in range(len(features)) if low[f] != high[f]], radix, JOINT if together else 1)
    codes = [Layout([pack], edges, missing).code(pack, bins.__getitem__) for pack in packs] if together else []
    stop, trees = Stopper(p.patience), []
    for r in range(p.rounds):
        g, h = gradients(margin, y, w)
        used = learn & np.concatenate([bagged(p, r, b, n) for b, n in blocks])
        fs = [f for f in round_features(p, r, len(features)) if low[f] != high[f]]
        lay = Layout(packs, edges, missing, fs)
        growing = Growing(p, edges)
        rows = {0: np.flatnonzero(used)}  # of each open node
        growing.begin(np.array([total(g, used), total(h, used), len(rows[0])]))
        if not fs:
            growing.open = []
        level: dict[int, np.ndarray] = {}
        while growing.open:
            counted, rest = growing.halves(level)
            sums = np.zeros((len(counted), STATS, lay.width))
            if together:
                at = np.concatenate([rows[node] for node in counted])
                slot = np.repeat(np.arange(len(counted)), [len(rows[node]) for node in counted])
                for k in range(0, len(at), COUNTED):
                    some, those = at[k:k + COUNTED], slot[k:k + COUNTED]
                    first, last = those[0], those[-1] + 1  # rows stand by nodes
                    sums[first:last] += histogram(lambda f: bins[f][some], those - first, g[some], h[some], last - first, lay, lambda i: codes[i][some])  # noqa: B023
            else:
                for a, b in itertools.pairwise(ends):
                    inside = [rows[node][slice(*np.searchsorted(rows[node], (a, b)))] for node in counted]
                    some = np.concatenate(inside)
                    sums += histogram(lambda f: bins[f][some], np.repeat(np.arange(len(counted)), [len(x) for x in inside]), g[some], h[some],  # noqa: B023
                                      len(counted), lay)
            level = completed(level, counted, rest, sums)
            opened = growing.open
            growing.split(best_of(np.stack([level[node] for node in opened]), lay, p, together))
            for node in opened:
                mine, tree = rows.pop(node), growing.tree
                if tree.left[node] >= 0:
                    b = bins[tree.feat[node]][mine]
                    left = (b <= tree.cut[node]) | (b == MISSING) if tree.missing_left[node] else b <= tree.cut[node]
                    rows[tree.left[node]], rows[tree.right[node]] = mine[left], mine[~left]
        trees.append(growing.tree)
        margin = _replayed(margin, bins, [growing.tree])
        loss = [log_loss(margin[a:b][val[a:b]], y[a:b][val[a:b]], w[a:b][val[a:b]]) for a, b in itertools.pairwise(ends)]
        weights = sum(x[1] for x in loss)
        if stop.add(sum(x[0] for x in loss) / weights if weights else None):
            break
    return BoostModel(features, init, stop.kept(trees), p, stop.losses)


def _local(features, edges, p):
    def run(batches):
        parts = []
        for b in batches:
            for row in b.to_pylist():
                bins, y, w, val, _ = _unpacked(row, len(features))
                parts.append((row["block"], bins, y, w, val))
        if parts:
            parts.sort(key=lambda x: x[0])
            yield pa.RecordBatch.from_arrays([pa.array([train_arrays(parts, features, edges, p, together=False).to_json()])], ["model"])

    return run


def _replayed(margin: np.ndarray, bins: np.ndarray, trees: list[Tree]) -> np.ndarray:
    out = margin.copy()
    step = 1 << 14  # rows at a time whose bits stay in a core's cache
    for t in trees:
        value = np.array(t.value)
        for k in range(0, len(out), step):
            out[k:k + step] += value[t.by_bins(bins[:, k:k + step])]
    return out


def _distributed(blocks: DataFrame, features: list[str], edges: list[np.ndarray], p: BoostParams) -> BoostModel:
    d = len(features)
    spark = blocks.sparkSession
    groups = max(1, min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), d))
    dealt = data = _dealt(blocks)
    begun = data.mapPartitions(_begin(d)).collect()  # two sums and two bytes a feature of each task
    init = start_margin(sum(x[0] for x in begun), sum(x[1] for x in begun))
    low, high = np.min([x[2] for x in begun], axis=0), np.max([x[3] for x in begun], axis=0)
    missing = (high == MISSING).tolist()
    radix = [len(e) + 1 + m for e, m in zip(edges, missing, strict=True)]
    trees: list[Tree] = []
    saved = 0  # trees whose values the blocks' margins hold
    stop = Stopper(p.patience)
    for r in range(p.rounds):
        if r and r % p.keep == 0:
            # from the dealt blocks and all trees, so that what was kept before can go
            old, data, saved = data, _remargined(dealt, trees, d), r
            if old is not dealt:
                old.unpersist()
        growing = Growing(p, edges)
        growing.begin(np.zeros(STATS))
        fs = [f for f in round_features(p, r, d) if low[f] < high[f]]
        # a stage of its own costs more than adding up a few tasks' sums, whose size the rows do not change
        counted = max(1, min(p.max_leaves // 2, 1 << max(p.max_depth - 2, 0)))
        near = data.getNumPartitions() * counted * sum(len(edges[f]) + 2 for f in fs) * STATS * 8 <= p.driver_bytes
        to = 1 if near else groups
        packs = packed(fs, radix, JOINT)
        lays = [Layout(packs[k::to], edges, missing) for k in range(to)]
        level: dict | RDD = {}
        kept: list[RDD] = []
        grown = True
        while growing.open:
            counted, rest = growing.halves(_known(growing))
            sums = data.mapPartitions(_sums(trees[saved:], growing, counted, init, lays, p, r, d))
            search = _search(growing, counted, rest, lays, p)
            if near:
                best, totals, level = search(0, sums.collect(), level)
            else:
                # an open node's best a group; the group's sums stay where they are for the level below
                sums = sums.partitionBy(to, int)
                found = (sums.union(level) if kept else sums).mapPartitions(_group(search), True).persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(found)
                level = found.filter(_is_level)
                got = [x for k, (_, x) in found.filter(_is_found).collect()]
                totals = next((t for _, t in got if t is not None), None)
                best = [_first([b for b in each if b is not None], p) for each in zip(*[b for b, _ in got], strict=True)] if got else [None] * len(growing.open)
            if growing.depth == 0:
                totals = np.zeros(5) if totals is None else totals
                if r and stop.add(float(totals[3] / totals[4]) if totals[4] else None):
                    grown = False
                    break
                growing.total(totals)
            growing.split(best)
        for x in kept:
            x.unpersist()
        if not grown:
            break
        trees.append(growing.tree)
    else:
        last = np.sum([np.zeros(2), *data.mapPartitions(_losses(trees[saved:], init, d)).collect()], axis=0)  # two sums a task
        stop.add(float(last[0] / last[1]) if last[1] else None)
    data.unpersist()
    dealt.unpersist()
    return BoostModel(features, init, stop.kept(trees), p, stop.losses)


def _first(found: list[dict], p: BoostParams) -> dict | None:
    """Of the groups' best splits of a node the best, the first feature's of equals."""
    if not found:
        return None
    top = max(found, key=lambda b: b["gain"])
    least = top["gain"] - near_by(top["gain"], top["l0"] + top["r0"], top["l1"] + top["r1"], p)
    return min((b for b in found if b["gain"] >= least), key=lambda b: b["f"])


def _known(growing: Growing) -> list[int]:
    """The nodes of the level above whose sums are known: those that were split last."""
    t = growing.tree
    return [k for k, left in enumerate(t.left) if left >= 0 and (left in growing.open or t.right[k] in growing.open)]


def _dealt(blocks: DataFrame) -> RDD:
    """The blocks in turn to as many tasks as there are cores, or files' parts if these are more."""
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, blocks.rdd.getNumPartitions())
    return blocks.repartition(parts).rdd.map(lambda x: x.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def _remargined(dealt: RDD, trees: list[Tree], d: int) -> RDD:
    """The dealt blocks with the trees' values in their margins, kept where they are made."""
    out = dealt.map(_remargin(list(trees), d)).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def _begin(d: int):
    """A task's label and weight sums of the training rows, and the least and largest bin of each feature."""
    def run(rows):
        pos = weights = 0.0
        low, high = np.full(d, MISSING, np.uint8), np.zeros(d, np.uint8)
        for row in rows:
            bins, y, w, val, _ = _unpacked(row, d)
            pos += float((w * y)[~val].sum())
            weights += float(w[~val].sum())
            if row["n"]:
                low, high = np.minimum(low, bins.min(axis=1)), np.maximum(high, bins.max(axis=1))
        yield pos, weights, low, high

    return run


def _remargin(trees: list[Tree], d: int):
    def run(row):
        bins, *_, margin = _unpacked(row, d)
        return {**row, "margin": _replayed(margin, bins, trees).tobytes()}

    return run


def _losses(trees: list[Tree], init: float, d: int):
    """A task's validation loss and its weights."""
    def run(rows):
        out = np.zeros(2)
        for row in rows:
            bins, y, w, val, margin = _unpacked(row, d)
            out += log_loss((init + _replayed(margin[val], bins[:, val], trees)), y[val], w[val])
        yield out

    return run


def _summed(rows, trees: list[Tree], growing: Growing, counted: list[int], init: float, lays: list[Layout], p: BoostParams, round_: int, d: int) -> tuple:
    """(least block, each group's sums of the nodes to count, sums of the rows that the round trains on and the validation rows' loss) of some blocks."""
    total = [np.zeros((len(counted), STATS, lay.width)) for lay in lays]
    src, root = None, np.zeros(5)
    some: list[tuple] = []

    def count():
        bins, slot, g, h = (np.concatenate([x[k] for x in some], axis=-1) for k in range(4))
        some.clear()
        for sums, lay in zip(total, lays, strict=True):
            sums += histogram(bins.__getitem__, slot, g, h, len(counted), lay)

    for row in rows:
        bins, y, w, val, margin = _unpacked(row, d)
        m = init + _replayed(margin, bins, trees)
        g, h = gradients(m, y, w)
        use = ~val & bagged(p, round_, row["block"], len(y))
        if growing.depth == 0:
            root += [g[use].sum(), h[use].sum(), use.sum(), *log_loss(m[val], y[val], w[val])]
        slot = growing.slots(growing.tree.by_bins(bins), counted)
        at = np.flatnonzero(use & (slot >= 0))
        some.append((np.take(bins, at, axis=1), slot[at], g[at], h[at]))
        if sum(len(x[1]) for x in some) >= COUNTED:
            count()
        src = row["block"] if src is None else min(src, row["block"])
    if some:
        count()
    return src, total, root


def _sums(trees: list[Tree], growing: Growing, counted: list[int], init: float, lays: list[Layout], p: BoostParams, round_: int, d: int):
    """A task's sums, each group's features to the group; the root's sums and loss to the first."""
    def run(rows):
        src, total, root = _summed(rows, trees, growing, counted, init, lays, p, round_, d)
        if src is not None:
            for k, sums in enumerate(total):
                yield k, (src, sums.tobytes(), root if k == 0 and growing.depth == 0 else None)

    return run


def _search(growing: Growing, counted: list[int], rest: dict[int, tuple[int, int]], lays: list[Layout], p: BoostParams):
    """Of a group's sums from all tasks and those of the level above: (each open node's best split, the root's sums, the level's sums)."""
    def run(group, rows, above):
        lay = lays[group]
        # added up in the order of the tasks' blocks, so that a repeated run gives the same sums
        rows = sorted(rows, key=lambda x: x[1][0])
        sums = sum((np.frombuffer(x[1], np.float64) for _, x in rows), np.zeros(len(counted) * STATS * lay.width))
        level = completed(above, counted, rest, sums.reshape(len(counted), STATS, lay.width))
        totals = sum(x[2] for _, x in rows) if rows and rows[0][1][2] is not None else None
        return best_of(np.stack([level[node] for node in growing.open]), lay, p), totals, level

    return run


def _group(search):
    """A group's step as two rows: what was found, and its sums for the level below."""
    def run(rows):
        rows = list(rows)
        if rows:
            above = next((x[1] for _, x in rows if x[0] is None), {})
            best, totals, level = search(rows[0][0], [x for x in rows if x[1][0] is not None], above)
            yield rows[0][0], ("found", (best, totals))
            yield rows[0][0], (None, level)

    return run


def _is_found(x) -> bool:
    return x[1][0] == "found"


def _is_level(x) -> bool:
    return x[1][0] is None


# ----------------------------------------------------- a first split's gains
def root_gains(df: DataFrame, features: list[str], params: BoostParams | None = None, label: str = "TARGET") -> DataFrame:
    """Per feature the best gain of the first split (all rows, no sampling): (feature, n_cuts, n_missing, best_gain)."""
    p = params or BoostParams()
    edges = bin_edges(df.where(F.col(label).isNotNull()), features, p.bins)
    blocks = to_blocks(df, features, edges, label, None, None)
    d = len(features)
    whole = BoostParams(**{**asdict(p), "bagging_fraction": 1.0})
    mean = df.where(F.col(label).isNotNull()).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.count(label).alias("n")).first()
    init = start_margin(mean["pos"] or 0.0, mean["n"])
    growing = Growing(whole, edges)
    growing.begin(np.zeros(STATS))
    lay = Layout(packed(list(range(d)), [len(e) + 2 for e in edges], JOINT), edges)
    groups = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums_of(batches):
        src, (total,), _ = _summed((r for b in batches for r in b.to_pylist()), [], growing, [0], init, [lay], whole, 0, d)
        if src is not None:
            each = [total[0, :, lay.start[k]:lay.start[k] + lay.size[k]] for k in range(d)]
            at = [k for k in range(d) if each[k][2].any()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k % groups for k in at], pa.int32()), pa.array(at, pa.int32()), pa.array([src] * len(at), pa.int64()),
                 pa.array([each[k].tobytes() for k in at], pa.binary())], ["grp", "k", "src", "sums"])

    sums = blocks.mapInArrow(sums_of, "grp int, k int, src long, sums binary")
    sizes = [len(e) for e in edges]

    def run(group: pa.Table) -> pa.Table:
        out = []
        k = group.column("k").to_numpy()
        all_sums = group.column("sums").to_pylist()
        for f in np.unique(k).tolist():
            one = sum(np.frombuffer(all_sums[i], np.float64) for i in np.flatnonzero(k == f)).reshape(STATS, -1)
            gain = float(best_splits(one[None], whole)["gain"][0])
            out.append((features[f], sizes[f], int(round(one[2, -1])), gain if np.isfinite(gain) else None))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64()]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["feature", "n_cuts", "n_missing", "best_gain"])

    return sums.groupBy("grp").applyInArrow(run, "feature string, n_cuts int, n_missing long, best_gain double")
