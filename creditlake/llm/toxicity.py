"""Toxicity by maximum-scoring segments of token log-odds.

1. Tokens (runs of letters, lower case) are hashed into ``2**BUCKET_BITS``
   buckets and counted (``MOST`` times a document at most) over a bounded sample of labelled
   documents, toxic and other, by a Spark aggregate of at most two rows a bucket.
2. A bucket's score is its log-odds between the two classes under an
   informative Dirichlet prior (the pooled frequencies, weighing as much as the
   toxic class), taken at the end of its confidence interval that is nearer to
   zero, less a small drift.  Chance differences so score below zero, and those under
   ``FLOOR`` do too.
3. A linear scan finds every maximal segment of positive sum of the whole text.
4. Segment scores are calibrated as extreme values: a text of n tokens has
   K n exp(-lambda s) segments of score s or more by chance.  lambda solves
   E exp(lambda score) = 1 over the other class's tokens, K is its maximum
   likelihood estimate on the sample's other documents.
5. A logistic regression on a text's best segment and its number of significant
   passages, fitted on the same sample, gives the score.

Defined results: null and empty texts have no segment and the score of that;
whole texts are read; rows are scored one by one, repeated ones too; without
labels of both classes every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import map_texts
from creditlake.llm.sampling import labelled

#: Labelled documents learnt from, at most.
SAMPLE = 20_000
BUCKET_BITS = 18
#: A document's repetitions of a token count up to so often.
MOST = 5
Z = 1.96
#: Smaller scores above zero are noise.
FLOOR = 0.5
DRIFT = 0.01
E_VALUE = 0.01
THRESHOLD = 0.7
#: ASCII letters lowered, other ASCII made blank; bytes of other letters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def buckets(text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(_TABLE).split()
    crc, top = zlib.crc32, (1 << BUCKET_BITS) - 1
    return np.array([crc(w) & top for w in words], np.int64)


class Segment(NamedTuple):
    start: int  # first word
    end: int  # behind the last word
    score: float


def segments(scores: np.ndarray) -> list[Segment]:
    """All maximal scoring segments, in order (Ruzzo and Tompa's linear scan, over the positive scores alone)."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    stack: list[list] = []  # [start, end, sum before, sum behind]
    link: list[int] = []  # for each, the nearest one before with a smaller sum before it
    for k in at.tolist():
        seg = [k, k + 1, sums[k], sums[k + 1]]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = link[j]
            if j < 0 or stack[j][3] >= seg[3]:
                stack.append(seg)
                link.append(j)
                break
            seg = [stack[j][0], seg[1], stack[j][2], seg[3]]
            del stack[j:], link[j:]
    return [Segment(a, b, float(r - le)) for a, b, le, r in stack]


class Model(NamedTuple):
    scores: np.ndarray
    lam: float
    k: float
    weights: tuple

    def passages(self, text: bytes | None) -> tuple[int, list[Segment]]:
        b = buckets(text)
        return len(b), segments(self.scores[b])

    def e_value(self, score: float, n: int) -> float:
        return self.k * max(n, 1) * math.exp(-self.lam * min(score, 600 / self.lam))

    def features(self, n: int, found: list[Segment]) -> tuple[float, float]:
        """Log-significance of the best segment (bounded), and the logarithm of the significant ones' number."""
        best = max((s.score for s in found), default=0.0)
        sig = sum(self.e_value(s.score, n) <= E_VALUE for s in found)
        return min(max(-math.log(self.e_value(best, n) + 1e-30), -5.0), 30.0), math.log1p(sig)

    def score(self, n: int, found: list[Segment]) -> float:
        if self.weights is None:
            return 0.0
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(n, found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def token_scores(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Scores by bucket from the two classes' counts."""
    n_t, n_o = toxic.sum(), other.sum()
    prior = n_t * (toxic + other + 0.01) / (n_t + n_o + 0.01 * len(toxic))
    a_t, a_o = toxic + prior, other + prior
    odds = np.log(a_t / (a_t.sum() - a_t)) - np.log(a_o / (a_o.sum() - a_o))
    slack = Z * np.sqrt(1 / a_t + 1 / a_o)
    sure = np.sign(odds) * np.maximum(np.abs(odds) - slack, 0)
    return np.where((sure > 0) & (sure < FLOOR), 0, sure) - DRIFT


def solve_lambda(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive root of E exp(lambda score) = 1; the mean score must be negative."""
    p = counts / max(counts.sum(), 1)
    f = lambda lam: float((p * np.exp(np.minimum(lam * scores, 700))).sum()) - 1
    lo, hi = 1e-6, 1e-3
    while f(hi) < 0 and hi < 50:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple:
    """Newton's method for a logistic regression with an intercept."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        pull = ridge * np.array([0.0, *np.ones(len(w) - 1)])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9), x.T @ (y - p) - pull * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                found, n = np.unique(buckets(b.column(0)[i].as_py()), return_counts=True)
                total[int(bool(b.column(1)[i].as_py())), found] += np.minimum(n, MOST)
        y, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(at, pa.int32()), pa.array(total[y, at])], ["y", "bucket", "n"])

    got = sample.select(F.col("t").cast("binary"), "y").mapInArrow(run, "y int, bucket int, n long").groupBy("y", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 1 << BUCKET_BITS))
    out[got["y"].to_numpy(), got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out[1], out[0]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Model:
    rows = labelled(docs, labels, label_col, may_learn, sample, F.coalesce(F.col(text_col).cast("string"), F.lit("")), id_col)
    toxic, other = _counts(rows)
    none = Model(np.full(1 << BUCKET_BITS, -DRIFT), 1.0, 1.0, None)
    if not toxic.sum() or not other.sum():
        return none
    scores = token_scores(toxic, other)
    start = Model(scores, solve_lambda(scores, other), 1.0, None)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [start.passages(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([max((s.score for s in found), default=0.0) for _, found in out], pa.float64())], ["n", "s"])

    texts = rows.select(F.col("t").cast("binary"), "y")
    clean = [(r.n, r.s) for r in texts.where("y = 0").mapInArrow(best, "n long, s double").collect()]
    k = len(clean) / max(sum(max(n, 1) * math.exp(-start.lam * s) for n, s in clean), 1e-9)
    model = start._replace(k=k)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.features(*model.passages(x.as_py())) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in out], pa.float64()), pa.array([c for _, c in out], pa.float64()), b.column(1)], ["best", "many", "y"])

    got = texts.mapInArrow(features, "best double, many double, y int").collect()
    return model._replace(weights=logistic(np.array([(r.best, r.many) for r in got]), np.array([float(r.y > 0) for r in got])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_words, passages): passages are the significant segments, with E-values."""
    kind = "doc_id long, score double, predicted int, n_words long, passages array<struct<start:int,end:int,score:double,e_value:double>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BUCKET_BITS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        inner = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                n, found = m.passages(b.column(1)[i].as_py())
                p = m.score(n, found)
                sig = [(s.start, s.end, s.score, e) for s in found if (e := m.e_value(s.score, n)) <= E_VALUE]
                rows.append((p, int(p >= THRESHOLD), n, [dict(zip(("start", "end", "score", "e_value"), x, strict=True)) for x in sig]))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.float64(), pa.int32(), pa.int64(), inner)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
                                             ["doc_id", "score", "predicted", "n_words", "passages"])

    return map_texts(docs.select(docs[id_col].cast("long"), F.col(text_col).cast("binary")), run, kind)
