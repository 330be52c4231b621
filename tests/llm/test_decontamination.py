import random
import string
from collections import Counter
from math import comb

import duckdb
import numpy as np
import pyarrow as pa

from creditlake.llm import decontamination as D


def split(t):
    return (t or "").lower().translate(str.maketrans("", "", string.punctuation)).split()


def shingles(w, width=5):
    return [tuple(w[i:i + width]) for i in range(len(w) - width + 1)]


def plain(docs, items):
    """Brute force over all aligned windows."""
    out = set()
    items = [(j, split(u)) for j, u in set(items)]
    for i, t in set(docs):
        w = split(t)
        for j, v in items:
            width, at = max(1, min(5, len(v))), {}
            x, y = shingles(w, width), shingles(v, width)
            for p, s in enumerate(x):
                at.setdefault(s, []).append(p)
            b, best = Counter(y), None
            for s in {p - q for q, sh in enumerate(y) for p in at.get(sh, ())}:
                lo, hi = max(s, 0), min(s + len(v), len(w))
                a = Counter(x[lo:hi - width + 1])
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8 and (best is None or (sim, -lo) > best[:2]):
                    best = sim, -lo, hi - lo
            if best:
                out.add((i, j, -best[1], best[2], best[0]))
    return out


def test_matches_equal_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(60)]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.randint(9, 60)))) for j in range(12)]
    items += [(50, "too short it is"), (51, None), (52, ""), (0, items[0][1]), (53, "again " * 20), (None, "a null id is fine here too ok")]
    docs = []
    for i in range(40):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        j, t = rng.choice(items[:12])
        t = t.split()
        if i % 2:
            if i % 4 == 1 and len(t) > 30:
                t[rng.randrange(len(t))] = "edit"
            if i % 8 == 3:
                t = t[1:]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() + "!!" if i % 3 else x for x in t]
        docs.append((i, " ".join(w)))
    docs += [(95, "so TOO short, it is."), (96, "a too short it is b too short it is"), (97, "too short it"), (98, "one")]
    items += [(54, "One"), (55, "...")]
    docs += [(90, None), (91, ""), (1, docs[1][1]), (None, docs[3][1]), (92, "again " * 300), (93, "a null ID, is fine here too: ok"), (94, items[3][1])]
    dd = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id int, h string")
    bb = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in D.matches(dd, bb).collect()}
    want = plain(docs, items)
    assert got == want and len(want) > 15 and {(95, 50), (96, 50), (98, 54)} <= {m[:2] for m in want}
    kept = D.clean(dd, bb)
    bad = {(i, t) for i, t in docs if i in {m[0] for m in want}}
    assert kept.columns == dd.columns and sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted(
        d for d in docs if d not in bad and d[0] is not None and d[1])


def test_no_window_is_lost_by_the_radius(spark):
    """Windows at similarity 0.8 to 0.9: all are within the radius."""
    rng = random.Random(11)
    items, docs = [], []
    for j in range(150):
        w = [f"{j}x{k}" for k in range(rng.randint(40, 70))]
        items.append((j, " ".join(w)))
        w[rng.randrange(6, len(w) - 6)] = "edit"
        docs.append((j, " ".join(w)))
    got = D.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    sims = {i: 1 - 10 / (len(t.split()) - 4 + 5) for i, t in docs}
    assert {r.doc_id for r in got} == {i for i, s in sims.items() if s >= 0.8 - 1e-9} and {r.doc_id == r.item_id for r in got} == {True}


def bit_differs(total, item_total, shared):
    """The probability that a bit of a window's fingerprint and the item's differ, by exact binomials."""
    pmf = lambda n: np.array([comb(n, k) for k in range(n + 1)]) / 2.0**n
    k = np.arange(shared + 1)

    def up(n):
        below = np.concatenate([[0.0], np.cumsum(pmf(n - shared))])
        return 1 - below[np.clip(n // 2 + 1 - k, 0, n - shared + 1)]

    a, b = up(total), up(item_total)
    return float((pmf(shared) * (a * (1 - b) + b * (1 - a))).sum())


def test_radius_by_exact_binomials():
    """More than MAX_BITS bits differ in less than one of a million pairs at similarity 0.8 and over."""
    over = lambda p: sum(comb(64, d) * p**d * (1 - p) ** (64 - d) for d in range(D.MAX_BITS + 1, 65))
    worst = max(bit_differs(a, b, s) for b in range(1, 61) for a in range(-(-4 * b // 5), b + 1) for s in range(-(-4 * (a + b) // 9), a + 1))
    assert 0.15 < worst < 0.2 and over(worst) < over(0.25) < 1e-6


def test_short_clipped_and_repeated_items(spark):
    """Many windows of few shingles at similarity 0.8: 4 of 5, 12 of 15, and three words; and heavy repeats."""
    items, docs = [], []
    for j in range(400):
        w = [f"{j}x{k}" for k in range((9, 19, 3, 24)[j % 4])]
        if j % 4 == 3:
            w[:16] = [f"{j}r"] * 8 + [f"{j}s"] * 8
        items.append((j, " ".join(w)))
        docs.append((j, " ".join((w[1:], w[:-3], ["lead", *w, "tail"], w[:-2])[j % 4])))
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in D.matches(dd, bb).collect()}
    assert got == plain(docs, items) and len(got) == 400
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]}))
    c.register("benchmark", pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
    assert set(c.sql(D.oracle()).fetchall()) == got


def every_window(docs, items, width=5):
    """Brute force over all windows as long as an item, and the aligned ones at the ends: (doc, item, best similarity)."""
    out, cut = set(), {(i, j): s for i, j, _, _, s in plain(docs, items)}
    for i, t in docs:
        w = split(t)
        for j, u in items:
            v = split(u)
            b, best = Counter(shingles(v, width)), cut.get((i, j), 0.0)
            for s in range(max(len(w) - len(v), 0) + 1):
                a = Counter(shingles(w[s:s + len(v)], width))
                both = sum((a & b).values())
                best = max(best, both / max(sum(a.values()) + sum(b.values()) - both, 1))
            if best >= 0.8:
                out.add((i, j, round(best, 9)))
    return out


def test_windows_between_aligned_ones(spark):
    """Items whose parts a document has in another order, or with words between them, at its ends and inside: the best
    window is none of those that a shared shingle aligns."""
    rng = random.Random(5)
    items, docs = [], []
    for j in range(60):
        w = [f"{j}x{k}" for k in range(rng.randint(50, 110))]
        items.append((j, " ".join(w)))
        a, b = sorted(rng.sample(range(8, len(w) - 8), 2))
        moved = [w[a:] + w[:a], w[b:] + w[a:b] + w[:a], w[:a] + ["new"] * rng.randint(1, 3) + w[a:], w[a:b] + w[:a] + w[b:]][j % 4]
        around = [["lead"] * 7, []][j % 3 == 0], [["tail"] * 7, []][j % 3 == 1]
        docs.append((j, " ".join([*around[0], *moved, *around[1]])))
    dd, bb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in D.matches(dd, bb).collect()}
    want = every_window(docs, items)
    assert got == want and len(want) > 40 and want - {(i, j, round(s, 9)) for i, j, _, _, s in plain(docs, items)}


def test_very_long_text(spark):
    """An item in the middle of a text of 300,000 words."""
    w = [f"v{k % 9973}q{k % 7}" for k in range(300_000)]
    item = [f"i{k}" for k in range(30)]
    w[150_000:150_000] = item
    got = D.matches(spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity, r.bits) for r in got] == [(1, 2, 150_000, 30, 1.0, 0)]


def test_oracle(spark):
    p = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{p}/{t}.parquet'")
    got = D.matches(spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/benchmark.parquet"))
    want = c.sql(D.oracle()).fetchall()
    assert sorted(map(tuple, got.drop("row_key", "bits").collect())) == sorted(want) and want


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.matches(d.limit(0), b).collect() == [] == D.matches(d, b.limit(0)).collect()
    assert D.clean(d, b.limit(0)).count() == 1
