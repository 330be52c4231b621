import random

import numpy as np
import pyarrow as pa

from creditlake.llm import paragraph_dedup as P


def plain_units(text):
    """(begin, end, words) by definition."""
    lines = [x.split() for x in (text or "").encode().lower().split(b"\n")]
    words = [w for x in lines for w in x]
    out, at, ends = [], 0, set()
    for x in lines:
        if len(x) >= 25:
            out.append((at, at + len(x), True))
        at += len(x)
        if x:
            ends.add(at)
    ends |= {i + 1 for i, w in enumerate(words) if w[-1:] in (b".", b"!", b"?")}
    ends = sorted(ends)
    for b in [0, *ends[:-1]] if words else []:
        e = next((e for e in ends if e - b >= 25), len(words))
        e = min(e, b + 64, len(words))
        if e - b >= 25 and (b, e, True) not in out:
            out.append((b, e, False))
    return out, words


def texts(rng):
    def sentence():
        return " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 40))).capitalize() + rng.choice([".", "!", "?", ""])
    out = [None, "", "\n\n", " \x01 x", "one", "a " * 24, "a " * 25, "a. " * 30]
    return out + [rng.choice([" ", "\n", " \n ", "\t"]).join(sentence() for _ in range(rng.randint(1, 12))) for _ in range(40)]


def test_units():
    ts = texts(random.Random(1))
    h, stop, line, offsets = P.words_of(pa.array([t or "" for t in ts]))
    begin, end, whole = P.units(h, stop, line, offsets)
    doc = np.searchsorted(offsets, begin, "right") - 1
    got = sorted((int(d), int(b - offsets[d]), int(e - offsets[d]), bool(w)) for d, b, e, w in zip(doc, begin, end, whole, strict=True))
    assert got == sorted((i, *u) for i, t in enumerate(ts) for u in plain_units(t)[0])


def test_tune():
    for s in (0.7, 0.8, 0.9):
        b = P.tune(s, 0.99)
        assert 1 - (1 - s**3) ** b >= 0.99 > 1 - (1 - s**3) ** (b - 1)


def test_similar_equals_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        base = [rng.randint(0, 400) for _ in range(40)]
        sets = []
        for _ in range(25):
            s = list(base) if rng.random() < 0.7 else [rng.randint(0, 400) for _ in range(40)]
            for _ in range(rng.randint(0, 8)):
                s[rng.randrange(len(s))] = rng.randint(0, 400)
            sets.append(np.array(s, np.int32))

        def comps(edges):
            up = list(range(25))
            for a, b in edges:
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
            return up

        want = [(i, j) for i in range(25) for j in range(i) if len(a := set(sets[i].tolist())) and len(a & (b := set(sets[j].tolist()))) >= 0.8 * len(a | b)]
        got = P.similar(list(range(25)), sets, 0.8)
        assert comps(got) == comps(want) and len(got) <= 24


def para(rng, n=60):
    return " ".join(f"{rng.choice('bcdfgh')}{rng.randint(0, 400)}" for _ in range(n))


def test_repeats_are_found(spark):
    rng = random.Random(3)
    p, q, r = para(rng), para(rng, 80), ". ".join(para(rng, 12) for _ in range(6)) + "."
    near = q.split()
    near[40] = "edited"
    rows = [(1, f"{para(rng)}\n{p}\n{para(rng)}"), (2, f"{p.upper()}\n{para(rng)}"), (3, para(rng)), (4, q), (5, f"{para(rng, 20)}\n{' '.join(near)}"),
            (6, f"{para(rng, 30)} {r} {para(rng, 10)}"), (7, f"{para(rng, 9)}. {r}"), (8, " ".join([para(rng, 26)] * 3)), (9, None), (10, ""),
            (11, f"{para(rng, 30)}\nshort line that all share\n"), (12, f"{para(rng, 30)}\nshort line that all share\n"), (None, f"{p}\nx"), (3, None)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, words int")
    got = P.repeated(df).collect()
    by = {}
    for x in got:
        by.setdefault(x.component_id, []).append(x)
    docs = {frozenset((x.doc_id for x in c)) for c in by.values()}
    assert frozenset({1, 2, None}) in docs and frozenset({4, 5}) in docs and frozenset({6, 7}) in docs
    assert {x.doc_id for x in got} == {1, 2, 4, 5, 6, 7, None}
    assert {x.kind for x in got if x.doc_id in (4, 5) and x.start_word in (0, 20) and x.n_words == 80} == {"paragraph"}
    assert {x.kind for x in got if x.doc_id == 6} == {"passage"}
    for c in by.values():
        assert sum(not x.removed for x in c) >= 1 and min(x.doc_id for x in c if x.doc_id is not None) in {x.doc_id for x in c if not x.removed}
        assert all(x.component_units == len(c) for x in c)


def test_large_bands_are_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = para(rng, 60).split()
    rows = [(i, " ".join([*base, f"n{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(P, "BLOCK", 7)
    got = P.repeated(df).where("n_words = 61").collect()
    assert len({x.component_id for x in got}) == 1 and len(got) == 40 and sum(x.removed for x in got) == 39


def plain_repeats(rows):
    """Every unit that another row holds too, by equal words or, for paragraphs, similar shingles; with its class."""
    units = []
    for uid, (doc, text) in enumerate(rows):
        h, stop, line, offsets = P.words_of(pa.array([text or ""]))
        begin, end, whole = P.units(h, stop, line, offsets)
        sums = [tuple(h[i:i + 25].tolist()) for i in range(max(len(h) - 24, 0))]
        base = P._B1
        keys = np.array([(np.array(s, np.uint64) * P._power(25, base)).sum() for s in sums] + [0] * (len(h) - len(sums)), np.uint64)
        more = P.winnowed(P._mix(keys + np.uint64(25)), offsets) if len(h) else np.zeros(0, np.int64)
        got = {(int(b), int(e)): bool(w) for b, e, w in zip(begin, end, whole, strict=True)}
        for b in more.tolist():
            got.setdefault((b, b + 25), False)
        b0, e0, _ = P.short(line, offsets)
        for b, e in zip(b0.tolist(), e0.tolist(), strict=True):
            got.setdefault((b, e), False)
        for (b, e), w in got.items():
            words = tuple(h[b:e].tolist())
            units.append((uid, doc, b, e - b, words, {words[i:i + 5] for i in range(len(words) - 4)} if w else None))
    up = list(range(len(units)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            same = a[4] == b[4] or (a[5] and b[5] and len(a[5] & b[5]) >= 0.8 * len(a[5] | b[5]))
            if same:
                up[find(i)] = find(j)
    groups = {}
    for i, u in enumerate(units):
        groups.setdefault(find(i), []).append(u)
    return sorted(sorted(((u[1], u[2], u[3]) for u in g), key=repr) for g in groups.values() if len({u[0] for u in g}) > 1)


def test_output_like_brute_force(spark):
    """The whole table, over texts with copies, near copies, repeated rows, shared passages and one very long text."""
    rng = random.Random(12)
    p, q = para(rng, 70), para(rng, 45)
    near = p.split()
    near[30] = "changed"
    rows = [(1, p), (2, p), (2, p), (3, " ".join(near)), (4, f"{para(rng, 33)} {q} {para(rng, 8)}"), (5, f"{q}\n{para(rng, 31)}"), (6, "few words"), (7, "few words"),
            (8, f"{q}\n{para(rng, 12)}\n{q}"), (9, None), (10, ""), (11, "\n".join([para(rng, 40) for _ in range(150)] + [" ".join(near)]))]
    got = {}
    for x in P.repeated(spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, uid string").repartition(3)).collect():
        got.setdefault(x.component_id, []).append((x.doc_id, x.start_word, x.n_words))
    assert sorted(sorted(c, key=repr) for c in got.values()) == plain_repeats(rows)


def test_empty_table(spark):
    assert P.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_passages(text):
    """Every run of 50 words."""
    w = (text or "").lower().split()
    return {tuple(w[i:i + 50]) for i in range(len(w) - 49)}


def test_passages_that_begin_anywhere(spark):
    rng = random.Random(5)
    rows = [(i, para(rng, rng.randint(30, 120))) for i in range(12)]
    for i in range(12, 40):  # without marks of sentences, in the middle of a line
        w = rows[rng.randrange(len(rows))][1].split()
        a = rng.randint(0, max(0, len(w) - 50))
        rows.append((i, " ".join([para(rng, rng.randint(7, 40)), *w[a:a + rng.choice([40, 50, 51, 70])], para(rng, rng.randint(7, 40))])))
    rows += [(40, "a " * 300), (41, "b " + "a " * 90), (42, "c d " * 200), (43, "d " + "c d " * 60)]
    got = {}
    for x in P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.component_id, set()).add(x.doc_id)
    shared = [(a, b) for a, s in rows for b, t in rows if a < b and plain_passages(s) & plain_passages(t)]
    assert len(shared) > 20
    assert all(any({a, b} <= docs for docs in got.values()) for a, b in shared)


def test_winnowed_leaves_one_in_each_window():
    rng = random.Random(6)
    sizes = [0, 24, 25, 48, 49, 300, 0, 26, 500, 400]
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    for values in (2, 5, 1 << 60):
        key = np.array([rng.randrange(1, values) for _ in range(offsets[-1])], np.uint64)
        got = set(P.winnowed(key, offsets).tolist())
        assert len(got) < 0.13 * offsets[-1]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            runs = range(a, b - 24)
            assert not got & set(range(max(a, b - 24), b))
            for lo in range(a, max(a + 1, b - 48)) if len(runs) else []:
                window = [p for p in runs if lo <= p < lo + 25]
                least = min(key[window])
                assert any(p in got and key[p] == least for p in window)


def test_short_lines_and_texts(spark):
    rng = random.Random(7)
    line = para(rng, 12)
    rows = [(1, f"{para(rng, 30)}\n{line}\n{para(rng, 30)}"), (2, f"{line.upper()}\n{para(rng, 40)}"), (3, "two words"), (4, " Two words\n"),
            (5, f"{para(rng, 30)}\ntwo words"), (6, line), (7, "two\nlines"), (8, "two lines"), (9, None), (10, ""), (11, " ")]
    got = {}
    for x in P.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(x.component_id, []).append((x.doc_id, x.n_words, x.removed))
        assert x.kind == ("text" if x.doc_id in (3, 4, 6, 7, 8) else "line")
    assert sorted(sorted(c) for c in got.values()) == [[(1, 12, False), (2, 12, True), (6, 12, True)], [(3, 2, False), (4, 2, True)], [(7, 2, False), (8, 2, True)]]
