import random

import numpy as np
import pytest
import xxhash

from creditlake.llm import simhash_vp as S


def plain_fingerprint(text, w=3):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i:i + w]) for i in range(len(words) - w + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain_components(fps, bits=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one two", "One TWO three", "a b c d a b c", "É é \x85 Ünï x\x1cy\xa0z " * 9, "x " * 40000])
def test_fingerprint(text):
    assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def clustered(rng, n):
    """Random fingerprints, chains of near ones and a dense group."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for x in out[:n // 4]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            out.append(x)
    base = rng.getrandbits(64)
    out += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)]
    return sorted(set(out))


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 8)
    fps = clustered(random.Random(1), 300)
    want = plain_components(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    for size in (10_000, 40):  # one shard; many shards
        edges = S.links(df, 3, size).collect()
        where = {int(np.uint64(x).astype(np.int64)): k for k, x in enumerate(fps)}
        up = S.Forest(len(fps))
        if edges:
            up.link(np.array([where[e.a] for e in edges]), np.array([where[e.b] for e in edges]))
        assert up.up.tolist() == want


def test_near_duplicates(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(40):
        t = [rng.choice(words) for _ in range(200)]
        rows.append((10 * i, " ".join(t)))
        if i % 4 == 0:
            rows.append((10 * i + 1, " ".join(t).upper()))
        if i % 5 == 0:
            t[7] = "new"
            rows.append((10 * i + 2, "\n".join(t)))
    rows += [(900, None), (901, ""), (902, "  "), (None, "alone in the world here"), (0, rows[0][1]), (3, "short"), (4, "SHORT")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, component_id string, fp int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(fps)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, f, least.get(r)) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, int(np.int64(r.fp).astype(np.uint64)), r.component_id) for r in got), key=str) == want


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
