import numpy as np
import pytest

from creditlake.llm import quality_cnn as C
from creditlake.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        t = bytes(i % 251 + 1 for i in range(n))
        part, first = C.chunks([b"xyz", t])
        own = part[first[1]:]
        step = C.CHUNK - C.OVERLAP
        whole = b"".join(bytes(r[:step]) for r in own[:-1]) + bytes(own[-1])
        assert whole.rstrip(b"\0") == t and (len(own) == 1 or len(t) > (len(own) - 1) * step)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = C.Net(*(rng.normal(0, 0.3, s) for s in ((256, C.EMBED), (C.WIDTH * C.EMBED, 5), (5,), (10,), (1,))))
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (40, 600, 0, 300)]
    y = np.array([1.0, 0, 1, 0])
    _, grads = C.gradients(net, texts, y)
    for p, g in zip(net, grads, strict=True):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g).ravel())[:6]]:
            was, e = p[at], 1e-6
            p[at] = was + e
            up = C.gradients(net, texts, y)[0]
            p[at] = was - e
            down = C.gradients(net, texts, y)[0]
            p[at] = was
            assert abs((up - down) / (2 * e) - g[at]) < 1e-5


@pytest.fixture(scope="module")
def net(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return C.fit(docs, labels, crc_bucket("doc_id", 4) != 2)


def test_held_out_accuracy(spark, net):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = C.score(docs, net).join(labels, "doc_id").where(crc_bucket("doc_id", 4) == 2).collect()
    good, bad = [r for r in got if r.quality], [r for r in got if not r.quality]
    assert sum(r.predicted for r in good) >= 0.95 * len(good) and sum(r.predicted for r in bad) <= 0.35 * len(bad)


def test_edges(spark, net):
    rows = [(1, None, 2), (2, "", 2), (2, "", 2), (None, "short", 2), (3, "word " * 100_000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted int")
    got = C.score(df, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert C.score(df.limit(0), net).collect() == []
    none = C.fit(df, spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int"), crc_bucket("doc_id", 4) != 9)
    assert none is None and all(r.score == 0 for r in C.score(df, none).collect())
