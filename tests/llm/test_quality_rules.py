import random
import re

import duckdb
import pytest

from creditlake.llm import quality_rules as Q

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    t = text or ""
    w = W.findall(t)
    lines = [x for x in t.split("\n") if W.search(x)]
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    cover = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 5)}
    n, rep = len(w), len(cover)
    failed = n < 10 or 100 * rep > 20 * n
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, failed)


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 30, "é ü # * 漢字 \x85 a\x1cb\xa0c <b>|&%$", "l1 the\nl1 the\n\nl1 the \nl2", "\n".join(["same line of the text here"] * 4)]
    for _ in range(60):
        v = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(5, 9))]
        out.append("".join(rng.choice(v) + rng.choice([" ", "  ", "\n", "\t", " # "]) for _ in range(rng.randint(1, 80))))
    return out + ["the long text of words " * 20000, "z" * 300000]


def test_measures(spark):
    rows = [(i, t, "x", True) for i, t in enumerate(texts())] + [(0, None, "x", True), (None, "no id", "x", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, kept boolean")
    got = Q.judge(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        if t and len(t) > 100_000:
            continue
        for r in by[i]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), t
            assert r.kept == (not r.base_failed and r.failed == "")
    big = next(r for r in got if r.n_words == 100_000)
    assert big.n_repeat_words == 100_000 and big.base_failed


def test_each_rule_can_fail_alone(spark):
    prose = [f"word{k} the" for k in range(60)]
    cases = {"word_length": " ".join(f"{'x' * 60}{k} of" for k in range(30)), "symbols": " ".join(f"{p} ##" for p in prose), "stop_words": " ".join(f"w{k}" for k in range(60)),
             "bullet_lines": "\n".join(f"- {p}" for p in prose), "cut_lines": "\n".join(f"of {p}..." for p in prose), "": " ".join(prose)}
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases.values())], "doc_id long, text string")
    assert [r.failed for r in Q.judge(df).orderBy("doc_id").collect()] == list(cases)


def test_clean_documents_are_kept(spark):
    d = "/root/testdata/sf0.01"
    got = Q.judge(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) < 0.6 * len(bad)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_oracle(spark, sf):
    p = f"/root/testdata/{sf}/documents.parquet"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{p}'")
    want = c.sql(Q.oracle()).fetchall()
    got = Q.judge(spark.read.parquet(p)).drop("n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines", "failed").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
