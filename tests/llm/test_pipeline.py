import random
import zlib

import corpus_pipeline as C
import numpy as np
import public_tokenizers
import pytest

from creditlake.llm import secret_scan as SS
from creditlake.llm.common import cut_lineage
from tests.llm.test_decontamination import plain as plain_matches
from tests.llm.test_simhash_vp import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """sf0.001 with planted cases, as a folder of tables."""
    d = tmp_path_factory.mktemp("world")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    key = "".join(np.random.default_rng(5).choice(list("ABCDEFGHabcdefgh0123456789"), 40))
    more = [(9000, None), (9001, ""), (9002, "12 34 !!"), (9003, texts[1]), (9004, texts[1].upper()), (1, texts[1]), (None, texts[2]),
            (9005, texts[4] + "\n" + item), (9006, texts[6] + f"\npassword = {key} and {key}.")]
    rows = [(i, t, None, "planted", None if t is None else len(t)) for i, t in more]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d), key


def bag(df):
    return sorted((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())


def test_stages_equal_brute_force(spark, world):
    sf, key = world
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(C.STAGES)
    assert list(steps) == ["language_id", "simhash_neardup", "decontamination", "secret_scan", "packing"]

    def step(name, df):
        out = cut_lineage(steps[name](spark, df, sf), name)
        assert out.columns == columns
        return out, [(r.doc_id, r.text) for r in out.collect()]

    before = [(r.doc_id, r.text) for r in docs.collect()]
    df, after = step("language_id", docs)
    assert sorted(map(str, after)) == sorted(str(x) for x in before if any(c.isalpha() for c in x[1] or ""))

    fps = [plain_fingerprint(t) for _, t in after]
    roots = plain_components(fps)
    df, kept = step("simhash_neardup", df)
    assert len(kept) == len(set(roots))
    least = {}
    for (i, _), r in zip(after, roots, strict=True):
        least[r] = min(least.get(r, (True, 0)), (i is None, i or 0))
    assert sorted((i is None, i or 0) for i, _ in kept) == sorted(least.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    df, clean = step("decontamination", df)
    bad = {m[0] for m in plain_matches(kept, items)}
    assert 9005 in bad and {i for i, _ in clean} == {i for i, _ in kept} - bad

    df, masked = step("secret_scan", df)
    assert sorted((str(i), t) for i, t in masked) == sorted((str(i), SS.mask(t)) for i, t in clean) and all(key not in t for _, t in masked)

    pieces = steps["packing"](spark, df, sf).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: tk.encode(t, add_special_tokens=False).ids + [2] for i, t in masked}
    assert {r.doc_id for r in pieces} == set(want)
    for r in pieces:
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, want.values()))


def test_run_is_the_stages_in_turn(spark, world):
    got = C.run(spark, world[0])
    assert C.ORACLE_SQL is None and {"doc_id", "sequence_id", "offset"} <= set(got.columns)
    ids = {r.doc_id for r in got.collect()}
    assert 9005 not in ids and 9003 not in ids and 9000 not in ids and 1 in ids


def test_empty_tables_pass_through(spark, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []


def test_queries_have_the_contract_columns(spark):
    from creditlake.llm import queries as Q

    first = {
        "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op2_simhash_neardup": ["doc_id", "fingerprint", "component_id"],
        "op3_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op6_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op7_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        "op11_piecewise_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        "op12_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op13_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]}
    qs = Q.queries()
    assert {int(k[2:].split("_")[0]) for k in qs} == set(range(1, 14))
    for k in [*random.Random(1).sample(sorted(first)[4:], 3), *sorted(first)[1:4]]:
        assert qs[k](spark, SF).columns[:len(first[k])] == first[k]
