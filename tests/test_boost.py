"""Boosted trees and Shapley values against plain searches over rows, splits and subsets."""
import itertools
import math
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.operators import boost as B
from creditlake.operators import shapley as S

NAMES = list("abcdef")


def table(n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    x[:, 3] = rng.integers(0, 4, n)
    x[:, 4] = 1.0
    y = (x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -0.5) + rng.normal(scale=0.7, size=n) > 0).astype(int)
    gone = rng.random((n, 6)) < np.array([0.0, 0.2, 0.1, 0.3, 0.0, 1.0])
    gone[:, 1] |= (y == 1) & (rng.random(n) < 0.4)       # missing b says something about y
    x[gone] = np.nan
    w = np.where(y == 1, 1.7, 1.0)
    return x, y, w, rng.random(n) < 0.2


def frame(spark, x, y, w, val):
    rows = [(i, int(y[i]), float(w[i]), bool(val[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, TARGET int, weight double, is_val boolean, " + ", ".join(f"{c} double" for c in NAMES))


def plain_best(x, g, h, edges, p):
    """The best split of all rows, by trying every feature, edge and side of the missing values."""
    def worth(rows):
        s = g[rows].sum()
        return (math.copysign(max(abs(s) - p.l1, 0), s)) ** 2 / (h[rows].sum() + p.l2)

    every = np.ones(len(x), bool)
    best = (-np.inf, None)
    for f in range(x.shape[1]):
        v = x[:, f]
        for e in [*edges[f].tolist(), np.inf]:
            for missing_left in (False, True):
                left = np.where(np.isnan(v), missing_left, v <= e)
                if min(left.sum(), (~left).sum()) < p.min_rows:
                    continue
                gain = worth(left) + worth(~left) - worth(every)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, e, missing_left if np.isnan(v).any() else None))
    return best


@pytest.mark.parametrize("l1, l2, rows", [(0.0, 0.0, 1), (3.0, 5.0, 40), (0.5, 0.1, 150)])
def test_one_round_is_the_exhaustive_search(spark, l1, l2, rows):
    x, y, w, val = table()
    p = B.BoostParams(rounds=1, max_depth=2, max_leaves=4, min_rows=rows, feature_fraction=1.0, bagging_fraction=1.0, l1=l1, l2=l2, bins=16)
    df = frame(spark, x, y, w, val).repartition(3)
    t = B.fit(df, NAMES, p).trees[0]
    edges = B.bin_edges(df.where("not is_val"), NAMES, 16)
    lx, ly, lw = x[~val], y[~val], w[~val]
    init = B.start_margin((lw * ly).sum(), lw.sum())
    g, h = B.gradients(np.full(len(lx), init), ly, lw)

    def check(node, rows):
        gain, split = plain_best(lx[rows], g[rows], h[rows], edges, p)
        assert abs(t.gain[node] - gain) < 1e-6 * max(1, gain)
        assert (t.feat[node], t.thr[node]) == split[:2] and (split[2] is None or t.missing_left[node] == split[2])
        v = lx[rows, t.feat[node]]
        left = np.where(np.isnan(v), t.missing_left[node], v <= t.thr[node])
        for child, part in ((t.left[node], rows[left]), (t.right[node], rows[~left])):
            s = g[part].sum()
            value = -p.learning_rate * math.copysign(max(abs(s) - l1, 0), s) / (h[part].sum() + l2)
            assert t.cover[child] == len(part) and abs(t.value[child] - value) < 1e-9
            if t.left[child] >= 0:
                check(child, part)

    check(0, np.arange(len(lx)))


def test_distributed_training_gives_the_local_trees(spark):
    x, y, w, val = table(1500, 4)
    df = frame(spark, x, y, w, val).repartition(4)
    p = B.BoostParams(rounds=7, max_depth=4, max_leaves=9, min_rows=20, bins=20, bagging_freq=2, keep=3, seed=3)
    edges = B.bin_edges(df.where("not is_val"), NAMES, p.bins)
    blocks = B.to_blocks(df, NAMES, edges, "TARGET", "weight", "is_val")
    local = B.fit_blocks(blocks, NAMES, edges, p)
    far = B.fit_blocks(blocks, NAMES, edges, B.BoostParams(**{**asdict(p), "local_rows": 0}))
    assert len(local.trees) == len(far.trees) > 3
    for a, b in zip(local.trees, far.trees, strict=True):
        assert (a.feat, a.cut, a.thr, a.missing_left, a.left, a.right, a.cover) == (b.feat, b.cut, b.thr, b.missing_left, b.left, b.right, b.cover)
        assert np.allclose(a.value, b.value, atol=1e-12)
    assert np.allclose(local.history, far.history, atol=1e-12)
    assert max(len([v for v in t.left if v < 0]) for t in local.trees) <= 9


def test_a_level_is_one_job_and_sums_may_be_added_up_anywhere(spark):
    x, y, w, val = table(1500, 9)
    df = frame(spark, x, y, w, val).repartition(4)
    p = B.BoostParams(rounds=6, max_depth=3, max_leaves=8, min_rows=20, bins=20, keep=4, seed=5, local_rows=0)
    edges = B.bin_edges(df.where("not is_val"), NAMES, p.bins)
    blocks = B.to_blocks(df, NAMES, edges, "TARGET", "weight", "is_val")
    sc = spark.sparkContext
    try:
        sc.setJobGroup("boost-jobs", "")
        near = B.fit_blocks(blocks, NAMES, edges, p)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    # rows, dealing, first sums, one rewriting of margins, last loss
    assert len(sc.statusTracker().getJobIdsForGroup("boost-jobs")) <= 6 * 3 + 8
    far = B.fit_blocks(blocks, NAMES, edges, B.BoostParams(**{**asdict(p), "driver_bytes": 0}))
    assert [(t.feat, t.cut, t.cover, t.value) for t in near.trees] == [(t.feat, t.cut, t.cover, t.value) for t in far.trees]
    assert len(near.trees) == 6 and near.history == far.history


def test_features_counted_together_have_the_sums_of_each():
    rng = np.random.default_rng(2)
    edges = [np.arange(k, dtype=float) for k in (1, 1, 2, 8, 40, 0, 5)]
    bins = np.stack([rng.integers(0, len(e) + 1, 5000) for e in edges]).astype(np.uint8)
    bins[1, rng.random(5000) < 0.3] = bins[4, rng.random(5000) < 0.1] = B.MISSING
    missing = [f in (1, 4) for f in range(7)]
    slot, g, h = rng.integers(0, 3, 5000), rng.normal(size=5000), rng.random(5000)
    fs = [0, 1, 2, 3, 4, 6]
    packs = B.packed(fs, [len(e) + 1 + m for e, m in zip(edges, missing, strict=True)], B.JOINT)
    assert len(packs) < 4 and sorted(f for pack in packs for f in pack) == fs
    lay = B.Layout(packs, edges, missing)
    got = B.histogram(bins.__getitem__, slot, g, h, 3, lay)
    codes = [lay.code(pack, bins.__getitem__) for pack in packs]
    part = B.Layout(packs, edges, missing, [1, 4])
    for f in part.features:
        a, b, n = part.start[f], lay.start[f], lay.size[f]
        assert np.allclose(B.histogram(bins.__getitem__, slot, g, h, 3, part, codes.__getitem__)[:, :, a:a + n], got[:, :, b:b + n], atol=1e-9)
    for f in lay.features:
        part = got[:, :, lay.start[f]:lay.start[f] + lay.size[f]]
        for s in range(3):
            for place in range(lay.size[f]):
                rows = (slot == s) & (bins[f] == (B.MISSING if place == lay.size[f] - 1 else place))
                assert np.allclose(part[s, :, place], [g[rows].sum(), h[rows].sum(), rows.sum()], atol=1e-9)
    assert np.array_equal(B.histogram(lambda f: bins[f, :0], slot[:0], g[:0], h[:0], 2, lay), np.zeros((2, 3, lay.width)))


def test_of_features_that_split_alike_the_first_is_taken():
    """However their sums were added up."""
    rng = np.random.default_rng(3)
    b = rng.integers(0, 9, 6000).astype(np.uint8)
    bins = np.stack([rng.integers(0, 3, 6000).astype(np.uint8), rng.integers(0, 50, 6000).astype(np.uint8), b, b, b])
    edges = [np.arange(k, dtype=float) for k in (2, 49, 8, 8, 8)]
    y = (rng.random(6000) < 0.1 + 0.08 * b).astype(float)
    p = B.BoostParams(rounds=12, feature_fraction=1.0, max_depth=4)
    m = B.train_arrays([(0, bins, y, np.ones(6000), np.zeros(6000, bool))], list("abcde"), edges, p)
    assert {f for t in m.trees for f in t.feat} <= {-1, 0, 1, 2}


def test_of_two_children_the_smaller_one_is_counted(monkeypatch):
    x, y, w, _ = table(4000, 6)
    x = np.nan_to_num(x)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 16) / 16)) for f in range(6)]
    block = (0, B.to_bins(x, edges), y.astype(float), w, np.zeros(4000, bool))
    seen, real = [], B.histogram
    monkeypatch.setattr(B, "histogram", lambda column, slot, *a: seen.append(len(slot)) or real(column, slot, *a))
    p = B.BoostParams(rounds=1, max_depth=5, max_leaves=31, min_rows=20, bagging_fraction=1.0)
    t = B.train_arrays([block], NAMES, edges, p).trees[0]
    assert len(seen) == 5 and seen[0] == 4000 and all(n <= 2000 for n in seen[1:])
    growing = B.Growing(p, edges)
    growing.tree, growing.depth, growing.open = t, 1, [t.left[0], t.right[0]]
    counted, _ = growing.halves(B._known(growing))
    row = {"block": 0, "n": 4000, "y": y.astype(np.float32).tobytes(), "w": w.tobytes(), "val": bytes(4000), "bins": block[1].tobytes(),
           "margin": np.zeros(4000).tobytes()}
    seen.clear()
    B._summed([row], [], growing, counted, 0.0, [B.Layout(B.packed(list(range(6)), [len(e) + 2 for e in edges], B.JOINT), edges)], p, 0, 6)
    assert len(counted) == 1 and sum(seen) <= 2000


def test_learns_and_stops_early(spark):
    x, y, w, val = table(2500, 7)
    df = frame(spark, x, y, w, val)
    m = B.fit(df, NAMES, B.BoostParams(rounds=150, patience=8, min_rows=20, learning_rate=0.3))
    assert len(m.trees) < 150 and m.history.index(min(m.history)) == len(m.trees) - 1
    back = B.BoostModel.from_json(m.to_json())
    got = back.scored(df.repartition(3), ["id", "is_val", "TARGET"]).collect()
    want = m.margin(x)
    assert max(abs(r.margin - want[r.id]) for r in got) < 1e-12 and all(0 < r.p < 1 for r in got)
    pos, neg = ([r.p for r in got if r.is_val and r.TARGET == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.8
    assert m.importance()["a"] > m.importance()["e"] == 0.0


def test_defined_without_rows_values_or_one_class(spark):
    x, y, w, val = table(60)
    df = frame(spark, x, y, w, val)
    assert B.fit(df.where("id < 0"), NAMES, B.BoostParams(rounds=2)).trees == []
    one = B.fit(df.withColumn("TARGET", F.lit(1)), NAMES, B.BoostParams(rounds=2, min_rows=1))
    assert all(r.p > 0.99 for r in one.scored(df, ["id"]).collect())
    few = B.fit(df, ["e", "f"], B.BoostParams(rounds=2, min_rows=1))      # a constant and an empty feature
    assert all(t.feat == [-1] for t in few.trees)


def plain_shapley(t, x):
    """By the definition, over all subsets of six features."""
    def value(known, node=0):
        if t.left[node] < 0:
            return t.value[node]
        f, l, r = t.feat[node], t.left[node], t.right[node]
        if f in known:
            left = t.missing_left[node] if np.isnan(x[f]) else x[f] <= t.thr[node]
            return value(known, l if left else r)
        return (t.cover[l] * value(known, l) + t.cover[r] * value(known, r)) / t.cover[node]

    n = len(x)
    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in itertools.combinations(rest, k):
                out[i] += math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value({*s, i}) - value(set(s)))
    return out, value(set())


def test_shapley_values_like_all_subsets(spark):
    x, y, w, val = table(1200, 11)
    rng = np.random.default_rng(1)
    x[:, 4:] = rng.normal(size=(1200, 2))
    y = (np.nan_to_num(x).sum(axis=1) + rng.normal(size=1200) > 0).astype(int)
    df = frame(spark, x, y, w, val)
    p = B.BoostParams(rounds=4, max_depth=7, max_leaves=60, min_rows=3, bins=30, feature_fraction=1.0)
    m = B.fit(df, NAMES, p)
    assert max(len(q.feats) for t in m.trees for q in S.paths(t)) >= 5 and max(len(q.conditions) for t in m.trees for q in S.paths(t)) == 7
    got = {r.id: r for r in S.shapley_values(df.repartition(3), m, ["id"]).collect()}
    assert len(got) == 1200 and max(abs(r.margin - r.model_margin) for r in got.values()) < 1e-9
    for i in [*range(12), *np.flatnonzero(np.isnan(x).sum(axis=1) > 2)[:6].tolist()]:
        each = [plain_shapley(t, x[i]) for t in m.trees]
        assert np.allclose(got[i].attributions, sum(e[0] for e in each), atol=1e-12)
        assert abs(got[i].base - m.init - sum(e[1] for e in each)) < 1e-12


def test_patterns_of_a_leaf_are_worked_out_once(monkeypatch):
    x, y, w, _ = table(3000, 12)
    edges = [np.unique(np.nanquantile(x[:, f], np.arange(1, 16) / 16)) if f < 5 else np.zeros(0) for f in range(6)]
    m = B.train_arrays([(0, B.to_bins(x, edges), y.astype(float), w, np.zeros(3000, bool))], NAMES, edges, B.BoostParams(rounds=5, min_rows=10))
    calls, real = [], S.pattern_values
    monkeypatch.setattr(S, "pattern_values", lambda *a: calls.append(1) or real(*a))
    explain = S.Explainer(m)
    got = np.vstack([explain.values(x[k:k + 500]) for k in range(0, 3000, 500)])
    assert len(calls) <= sum(len(ps) for ps in explain.paths)
    monkeypatch.setattr(S, "TABLED", 0)
    assert np.allclose(got, S.Explainer(m).values(x), atol=1e-12)
    assert np.allclose(got.sum(axis=1) + explain.base, m.margin(x), atol=1e-9)
