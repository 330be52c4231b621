import hashlib
import random

import numpy as np

from creditlake.llm import ctph as C

RND = random.Random(8)
WORDS = ["".join(RND.choice("etaoinshrdlu") for _ in range(RND.randrange(1, 9))) for _ in range(500)]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def plain_fingerprint(t: bytes) -> str:
    """A byte at a time, straight from the definition."""
    def hashes():
        out = []
        for i in range(len(t)):
            w = (bytes(6) + t)[i:i + 7]
            h = 0
            for c in w:
                h = (h * 0x01000193 + c) % 2**32
            h ^= h >> 15
            h = h * 0x85EBCA6B % 2**32
            out.append(h ^ h >> 13)
        return out

    import xxhash
    h = hashes()

    def sign(block, most):
        sig, lo = "", 0
        for i, x in enumerate(h):
            if x % block == block - 1 and len(sig) < most - 1:
                sig += C.SIGNS[xxhash.xxh64_intdigest(t[lo:i + 1]) >> 58]
                lo = i + 1
        return sig + (C.SIGNS[xxhash.xxh64_intdigest(t[lo:]) >> 58] if lo < len(t) else "")

    def chunks(block):
        return min(sum(x % block == block - 1 for x in h), 63)

    block = 3
    while block * 64 < len(t):
        block *= 2
    while chunks(block) < 31 and block > 3:
        block //= 2
    return f"{block}:{sign(block, 64)}:{sign(2 * block, 32)}"


def test_fingerprint_like_brute_force(monkeypatch):
    texts = [b"", b"a", b"abc" * 100, bytes(range(256)) * 9, "é漢😀".encode() * 50, b" " * 3000] + [prose(RND.randrange(1, 900)).encode() for _ in range(60)]
    want = [plain_fingerprint(t) for t in texts]
    assert [C.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(C, "SEGMENT", 10)
    assert [C.fingerprint(t) for t in texts] == want


def test_common_is_the_longest_common_subsequence():
    for _ in range(200):
        a, b = ("".join(RND.choice("ABC") for _ in range(RND.randrange(0, 20))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert C.common(a, b) == d[-1, -1]


def test_likeness():
    rnd = random.Random(3)
    far, near = [], []
    for n in (60, 300, 900, 4000):
        for _ in range(25):
            t = prose(n, rnd)
            w = t.split(" ")
            w[rnd.randrange(n)] = "changed"
            near.append(C.likeness(C.fingerprint(t.encode()), C.fingerprint(" ".join(w).encode())))
            far.append(C.likeness(C.fingerprint(t.encode()), C.fingerprint(prose(n, rnd).encode())))
            assert C.likeness(C.fingerprint(t.encode()), C.fingerprint(t.encode())) == 1
    assert min(near) > 0.6 and sum(near) / len(near) > 0.9 and sum(far) / len(far) < 0.05
    assert C.likeness("3:ABCDEFG:AB", "12:ABCDEFG:AB") == 0 and C.likeness("6:ABCDEFG:AB", "3:XY:ABCDEFG") == 1.0


def expected(rows):
    """Descending id, equal ids in any order of texts (none here have different texts of one id)."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        e = t[:len(t) - k] + nxt[:k]
        f, g, h = (C.fingerprint(x.encode()) for x in (t, e, nxt))
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), f, g, C.likeness(f, g), C.likeness(f, h)))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in C.against_next(df).collect()), key=repr)


def test_against_next_like_brute_force(spark):
    rows = [(i, prose(RND.randrange(0, 400))) for i in range(0, 300, 3)] + [(1, None), (2, ""), (4, "é漢😀" * 40), (None, "no id"), (-5, "x" * 9),
                                                                         (6001, "w " * 300_000), (7000, "same text") , (7000, "same text"), (7000, "same text")]
    RND.shuffle(rows)
    df = spark.createDataFrame([(i, t, "z", 1, "f") for i, t in rows], "doc_id long, text string, key string, part int, fingerprint string")
    want = expected(rows)
    assert run(df.repartition(5)) == want
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, some of them empty
    try:
        assert run(df.repartition(3)) == want
        assert run(df.where("doc_id = 4")) == expected([(4, "é漢😀" * 40)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_fingerprints(spark):
    rows = [(1, "x" * 50), (2, None), (None, "é漢😀" * 9)]
    got = C.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, len(t or ""), C.fingerprint((t or "").encode())) for i, t in rows), key=repr)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id long, text string")) == []
