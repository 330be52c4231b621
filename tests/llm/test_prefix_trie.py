import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from creditlake.llm import prefix_trie as T


def rebuilt(rows, fold=100, most=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most
        block = c - (c % fold if c >= 0 else -(-c % fold))
        out[c] = own.get(block, [])[:h] + v[h:]
    return out


def expected(rows, fold=100, most=6):
    seqs = rebuilt(rows, fold, most)
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in seqs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[:d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, m in members.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, part string, uid int, x1 int")


def run(df, **kw):
    return sorted((tuple(r) for r in T.prefix_nodes(df, **kw).collect()), key=repr)


def conversations(seed=1, n=150):
    rnd = random.Random(seed)
    rows = []
    texts = ["hi", "", None, "é漢😀", "a longer turn of text", "bye"]
    for c in [*range(0, n), *range(1000, 1000 + n // 3), -5, -100, -250]:
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts[:2] if t < 3 else texts)))
    copy = [(i, "user", f"copied {i}") for i in range(7)]
    rows += [(c, *x) for c in range(5000, 5090) for x in copy]            # exact copies
    rows += [(c, *x) for c in range(5200, 5230) for x in copy[:c % 8]]    # prefixes of them
    rows += [(6000, i, "user", f"long {i}") for i in range(900)]           # one long conversation, and its copy but for the end
    rows += [(6300, i, "user", f"long {i}") for i in range(899)]
    rows += [(7000, None, "user", "no number"), (7000, 3, "user", "three"), (7001, None, None, None), (None, 1, "user", "nobody's")]
    rows += [(7100, i, "user", "x") for i in range(9)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 3, 40, T.LIMIT])
def test_like_brute_force(spark, limit):
    rows = conversations(limit)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false" if limit == 3 else "true")  # conversations that run over ranges
    try:
        assert run(frame(spark, rows).repartition(3), limit=limit) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, i, "user", f"t{i % 50}") for i in range(6000)] + [(c, 0, "user", "t") for c in range(2, 40)]
    df = frame(spark, rows).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = T.numbered(df)
        assert placed.where("conv_id = 1").select("part").distinct().count() > 1
        assert sorted(r.i for r in placed.where("conv_id = 1").collect()) == list(range(1, 6001))
        assert run(df) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repeated_rows_and_ties(spark):
    rows = [(0, 1, "user", "same")] * 40 + [(8, 1, "user", "same")] * 3 + [(9, 1, "user", "same")]
    assert run(frame(spark, rows)) == expected(rows)


def test_other_folds(spark):
    rows = conversations(9, 60)
    assert run(frame(spark, rows), fold=10, most=3, limit=2) == expected(rows, 10, 3)


def test_double_array_finds_its_words_only():
    rnd = random.Random(2)
    words = [[rnd.randrange(40) for _ in range(rnd.randrange(1, 6))] for _ in range(500)]
    base, check = T.DoubleArray(words).arrays()

    def state(w):
        s = 0
        for a in w:
            t = base[s] + a
            if not 0 < t < len(check) or check[t] != s:
                return None
            s = t
        return s

    prefixes = {tuple(w[:d]) for w in words for d in range(len(w) + 1)}
    assert len({state(p) for p in prefixes}) == len(prefixes) and None not in {state(p) for p in prefixes}
    for _ in range(3000):
        w = tuple(rnd.randrange(45) for _ in range(rnd.randrange(1, 6)))
        assert (state(w) is not None) == (w in prefixes)


def test_empty_table(spark):
    assert run(frame(spark, []), ) == []
    assert run(frame(spark, [(None, 1, "user", "x")])) == []
