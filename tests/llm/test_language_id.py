import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.llm import language_id as L

SF = "/root/testdata/sf0.01"


def small_net(dtype=np.float64, hidden=3, k=3, seed=1):
    rng = np.random.default_rng(seed)
    return L.Net(("a", "b", "c")[:k], rng.normal(0, 0.4, (3, 512, hidden)).astype(dtype), rng.normal(0, 0.4, (3, 2, hidden, hidden)).astype(dtype),
                 rng.normal(0, 0.4, (2 * hidden, k)).astype(dtype), rng.normal(0, 0.1, k).astype(dtype))


def test_gradients_equal_differences(monkeypatch):
    real = np.float32
    monkeypatch.setattr(L.np, "float32", np.float64)
    try:
        net = small_net()
        rng = np.random.default_rng(2)
        seq, y = rng.integers(97, 100, (4, 7)).astype(np.uint8), np.array([0, 1, 2, 1])
        w = np.ones(seq.shape)
        _, grads = L.gradients(net, seq, y, w)
        for p, g in zip(net.params(), grads, strict=True):
            for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:6]]:
                was, e = p[at], 1e-5
                p[at] = was + e
                up = L.gradients(net, seq, y, w)[0]
                p[at] = was - e
                down = L.gradients(net, seq, y, w)[0]
                p[at] = was
                assert abs((up - down) / (2 * e) - g[at]) < 1e-5
    finally:
        monkeypatch.setattr(L.np, "float32", real)


def test_every_position_is_labelled_the_same_in_any_batch():
    net = small_net(np.float32)
    texts = [b"a" * 300, b"", b"bcd" * 200, b"x"]
    every = L.label(net, texts)
    for t, p in zip(texts, every, strict=True):
        assert np.allclose(L.label(net, [t])[0], p, atol=1e-6)
    assert every[1].sum() == 0 and np.allclose(every[[0, 2, 3]].sum(1), 1)


@pytest.fixture(scope="module")
def net(spark):
    return L.fit(spark.read.parquet(f"{SF}/documents.parquet"), L.learnable())


def test_held_out_accuracy(spark, net):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(~L.learnable()).collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark, net):
    rows = [(1, None, 5), (2, "", 5), (3, "123 !? – 4", 5), (4, "the " * 50_000, 5), (4, "the " * 50_000, 5), (None, "de la que", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = L.identify(df, net).collect()
    assert [r.lang_pred == "und" and r.score == 0 for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [True] * 3 + [False] * 3
    assert L.identify(df.limit(0), net).collect() == []
    nothing = L.fit(df.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert nothing is None and {r.lang_pred for r in L.identify(df, nothing).collect()} == {"und"}


def test_recognised_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.unionByName(spark.createDataFrame([(-1, "123 456", None, None, None), (-2, None, None, None, None)], docs.schema))
    kept = L.recognised(more)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect())


def test_rows_of_one_id_are_learnt_from(spark, monkeypatch):
    """Whatever the one id, and also if the rows are equal."""
    monkeypatch.setattr(L, "train", lambda texts, langs: (texts, langs))
    for one in (None, 1, 2, 3, 4, 5, 6, 7):
        df = spark.createDataFrame([(one, f"text {i}", "ab"[i % 2]) for i in range(100)] + [(one, None, "a")] * 300, "doc_id long, text string, lang string")
        texts, langs = L.fit(df, F.lit(True), sample=20)
        assert len(texts) == len(set(texts)) == 20 and set(langs) == {"a", "b"}
    assert L.fit(spark.createDataFrame([(None, "same", "a")] * 100, df.schema), F.lit(True), sample=20) == ([b"same"], ["a"])
