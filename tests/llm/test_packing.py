import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from creditlake.llm import packing as PK

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, max_len):
    """Every id in exactly one piece, pieces gapless in their sequence, sequences not too long."""
    want = sorted((i, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for i, x in docs)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= max_len
    for i, n, _ in want:
        assert sum(r.length for r in by_doc[i]) == n * sum(1 for w in want if w[0] == i)
    return by_seq


def padding(by_seq, max_len):
    sizes = [sum(r.length for r in s) for s in by_seq.values()]
    return sum(0 if n & (n - 1) == 0 else max_len - n for n in sizes), sum(sizes)


TEXTS = [None, "", "   \t\n", "Hello, world! it's <|endoftext|> a<|startoftext|>b", "naïve café n° 5 × 3 ÷ ª", "日本語 text – “quoted” \x1c sep\x85x",
         "é combining ́ x", "Straße ÀÉÎ Ÿ ÿ ß'S DON'T 'LL 12345 __a__ $$$!!", "ΣΑΣ ΟΔΟΣ", "a" * 5000, "word. " * 3000]


def test_ids_equal_the_tokenizer(spark):
    tk = PK.WordTokenizer(PATH)
    docs = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    ids, at = tk.encode(pa.array([t or "" for t in docs]))
    for k, (t, want) in enumerate(zip(docs, ids_of(docs), strict=True)):
        assert ids[at[k]:at[k + 1]].tolist() + [2] == want, t[:80]


def test_best_cuts_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        L, pos, p = 12, [], 0
        for _ in range(rng.randint(1, 9)):
            p += rng.randint(1, 12)
            pos.append(p)
        pen = [rng.choice([0, 1, 3]) for _ in pos]

        def cost(cuts):
            at, c = 0, 0
            for x in cuts:
                if x - at > L:
                    return 10**9
                c += L - (x - at) + pen[pos.index(x)]
                at = x
            return c

        got = PK.best_cuts(pos, pen, 0, L)
        best = min(cost([*s, pos[-1]]) for k in range(len(pos)) for s in itertools.combinations(pos[:-1], k))
        assert got[-1] == pos[-1] and cost(got) == best


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4095, 4096, 4000, 4040])
def test_tail_is_nearly_unpadded(n):
    cuts = PK.tail_cuts(10, 10 + n, 4096)
    sizes = np.diff([10, *cuts])
    assert sum(sizes) == n
    assert sum(0 if s & (s - 1) == 0 else 4096 - s for s in sizes.tolist()) <= PK.STEP_PENALTY


def test_pack_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id. here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string").coalesce(2)
    got = PK.pack(df, PATH).collect()
    ids = ids_of([r[1] for r in rows])
    check(got, [(r[0], x) for r, x in zip(rows, ids, strict=True) if r[0] is not None and r[0] != 3], PK.MAX_LEN)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    x = ids[10]
    for r in by_id[10]:
        assert r.ids_crc32 == zlib.crc32(np.asarray(x[r.start:r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(x)
    assert len([r for r in by_id[3] if r.start == 0]) == 2 and None in by_id


def test_pack_small_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    seqs = check(PK.pack(df, PATH).collect(), list(zip([d[0] for d in docs], ids_of([d[1] for d in docs]), strict=True)), PK.MAX_LEN)
    pad, total = padding(seqs, PK.MAX_LEN)
    assert pad < 0.01 * total


def test_cuts_are_document_or_sentence_ends():
    """Inside a sentence only where it is longer than an eighth of a window, or in the shard's remainder."""
    rng, L = random.Random(4), 256
    pk, at, ok, long_ = PK.Packer(L, 0, block_windows=4), 0, set(), []
    for i in range(300):
        sizes = [rng.choice([3, 5, 9, 14, 22, 90 if i % 50 == 0 else 7]) for _ in range(rng.randint(1, 40))]
        stops = np.cumsum(sizes)
        ok |= {at + int(x) for x in stops}
        long_ += [(at + int(e) - n, at + int(e)) for e, n in zip(stops, sizes, strict=True) if n > L // PK.STRETCH]
        pk.add(i, np.arange(stops[-1], dtype="<u4").tobytes(), stops[:-1])
        at += int(stops[-1])
    pk.finish()
    ends = np.cumsum([r[2] for r in pk.rows])
    inside = [e for e in ends.tolist() if e not in ok and e < at - L and not any(a < e < b for a, b in long_)]
    assert ends[-1] == at and not inside


def test_empty_table(spark):
    assert PK.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_short_shard_is_split_into_powers_of_two(spark):
    df = spark.createDataFrame([(1, "word " * 150)], "doc_id long, text string")
    assert sorted(r.length for r in PK.pack(df, PATH).collect()) == [1, 2, 4, 16, 128]


def test_long_document_stays_in_bounded_blocks():
    pk = PK.Packer(64, 0, block_windows=4)
    pk.add(1, np.arange(10_000, dtype="<u4").tobytes(), np.array([], np.int64))
    pk.add(2, np.arange(3, dtype="<u4").tobytes(), np.array([1]))
    pk.finish()
    assert sum(r[2] for r in pk.rows) == 10_003 and not pk.docs
