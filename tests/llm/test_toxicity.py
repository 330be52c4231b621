import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.llm import toxicity as T
from creditlake.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"


def brute(scores):
    """Maximal segments by their definition, by recursion on the best one (earliest, shortest)."""
    def rec(lo, hi):
        best = None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += scores[j]
                if s > 1e-12 and (best is None or s > best[0] + 1e-12):
                    best = s, i, j + 1
        if best is None:
            return []
        return rec(lo, best[1]) + [(best[1], best[2])] + rec(best[2], hi)
    return rec(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        x = [rng.choice([-3, -2, -1.5, 1, 2, 2.25, -0.75]) + rng.random() / 7 for _ in range(rng.randint(0, 25))]
        got = T.segments(np.array(x, float))
        assert [(s.start, s.end) for s in got] == brute(x)
        for s in got:
            assert math.isclose(s.score, sum(x[s.start:s.end]))


def test_scan_is_linear():
    n = 200_000
    x = np.where(np.arange(n) % 2, -1.0, 1.0) + np.linspace(0, 1e-3, n)
    assert T.segments(x) and T.segments(-np.ones(n)) == []


def test_calibration():
    scores, counts = np.array([2.0, -1.0]), np.array([1.0, 9.0])
    lam = T.solve_lambda(scores, counts)
    assert math.isclose(0.1 * math.exp(2 * lam) + 0.9 * math.exp(-lam), 1, abs_tol=1e-6)
    m = T.Model(scores, lam, 0.1, None)
    assert m.e_value(1, 100) > m.e_value(2, 100) < m.e_value(2, 1000)


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = T.fit(docs, labels, crc_bucket("doc_id", 3) != 1)
    return model, T.score(docs, model).withColumn("held", crc_bucket("doc_id", 3) == 1).join(labels, "doc_id").where("held").collect()


def test_held_out_accuracy(scored):
    got = scored[1]
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert any(r.passages for r in toxic) and all(0 <= r.score <= 1 for r in got)


def test_edges(spark, scored):
    model = scored[0]
    rows = [(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "12 !!", 0.5), (3, "the of and " * 100_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = T.score(df, model).collect()
    assert len(got) == 5 and not any(r.predicted for r in got) and len({r.score for r in got if r.doc_id != 3}) == 1
    assert T.score(df.limit(0), model).collect() == []
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    none = T.fit(df, labels, F.lit(True))
    assert none.weights is None and all(r.score == 0 for r in T.score(df, none).collect())


def test_fit_sees_all_passages(spark, monkeypatch):
    rng = random.Random(8)
    clean = lambda n: " ".join(f"w{chr(97 + rng.randrange(20))}" for _ in range(n))
    bad = lambda: " ".join(rng.choice(["vile", "foul", "nasty", "rotten"]) for _ in range(12))
    rows = [(i, clean(300), 0) for i in range(300)] + [(300 + i, " ".join(bad() for _ in range(3)), 1) for i in range(60)]
    rows.append((400, " ".join(f"{clean(60)} {bad()}" for _ in range(90)), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    plain = np.full(1 << T.BUCKET_BITS, -1.0)
    plain[T.buckets(b"vile foul nasty rotten")] = 2.0
    monkeypatch.setattr(T, "token_scores", lambda toxic, other: plain)
    monkeypatch.setattr(T, "solve_lambda", lambda scores, counts: 0.5)
    seen, real = [], T.logistic
    monkeypatch.setattr(T, "logistic", lambda x, y: (seen.append((x, y)), real(x, y))[1])
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    (x, y), = seen
    want = sorted((*model.features(*model.passages(t.encode())), float(c)) for _, t, c in rows)
    assert np.allclose(sorted((*a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)), want)
    assert max(math.expm1(c) for _, c, _ in want) > 64.5
