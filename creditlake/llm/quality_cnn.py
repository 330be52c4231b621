"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Learned
filters over byte embeddings run along each chunk, and their strongest response
in the chunk is kept (max-pooling).  A document's chunks are combined by the
mean and the maximum of these, of which a logistic layer makes one probability.

Trained with Adam on passages of a bounded sample of labelled documents
(``SAMPLE`` documents, ``PASSAGE`` characters each) with a fixed number of steps;
the weights (a few thousand numbers) go to the tasks.

Defined results: null and empty texts are one chunk of padding and score as
such; whole texts are read; rows are scored one by one, repeated ones too;
without labels to learn from every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import map_texts
from creditlake.llm.sampling import labelled, passage

#: Labelled documents learnt from, at most, and characters of each.
SAMPLE, PASSAGE = 4000, 2000
CHUNK, OVERLAP = 256, 32
EMBED, WIDTH, STRIDE, FILTERS = 6, 8, 2, 24
STEPS, BATCH, RATE = 350, 48, 0.01
#: This share of the passages learnt from is cut to a few bytes, between these bounds.
SHORT, SHORT_BYTES = 0.35, (12, 300)
THRESHOLD = 0.7
#: Chunks convolved at a time.
SLICE = 1024


class Net(NamedTuple):
    """embed (256, EMBED); filters (WIDTH * EMBED, FILTERS) with bias; out (2 * FILTERS,) with one bias."""
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    last: np.ndarray


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (n, CHUNK) of all texts, zero-padded, and where each text's begin.  A text has one at least."""
    step = CHUNK - OVERLAP
    need = np.array([max(1, -(-(len(t) - OVERLAP) // step)) for t in texts], np.int64)
    first = np.cumsum(need) - need
    out = np.zeros((int(need.sum()), CHUNK), np.uint8)
    for t, n, at in zip(texts, need.tolist(), first.tolist(), strict=True):
        row = np.zeros((n - 1) * step + CHUNK, np.uint8)
        row[:len(t)] = np.frombuffer(t, np.uint8)
        out[at:at + n] = np.lib.stride_tricks.sliding_window_view(row, CHUNK)[::step]
    return out, first


def _windows(net: Net, part: np.ndarray) -> np.ndarray:
    """(chunks * places, WIDTH * EMBED): the embedded bytes under each place of the filters."""
    x = net.embed[part].reshape(len(part), CHUNK * EMBED)
    w = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
    return w.reshape(-1, WIDTH * EMBED)


def pooled(net: Net, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, FILTERS) strongest responses (zero at least), and the places they come from."""
    places = (CHUNK - WIDTH) // STRIDE + 1
    top, at = [], []
    for lo in range(0, len(part), SLICE):
        r = (_windows(net, part[lo:lo + SLICE]) @ net.filters).reshape(-1, places, net.filters.shape[1])
        top.append(np.maximum(r.max(1) + net.bias, 0))
        at.append(r.argmax(1) if len(part) <= SLICE else None)
    return np.concatenate(top), at[0] if len(at) == 1 else None


def combine(f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * FILTERS): means and maxima of each text's chunks."""
    n = np.diff(np.append(first, len(f)))
    return np.concatenate((np.add.reduceat(f, first) / n[:, None], np.maximum.reduceat(f, first)), 1)


def probabilities(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    part, first = chunks(texts)
    x = combine(pooled(net, part)[0], first) @ net.out + net.last[0]
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))


def gradients(net: Net, texts: list[bytes], y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy and its gradients in the order of ``Net``."""
    part, first = chunks(texts)
    keep = SLICE
    f = np.empty((len(part), net.filters.shape[1]), net.filters.dtype)
    at = np.empty(f.shape, np.int64)
    for lo in range(0, len(part), keep):
        f[lo:lo + keep], at[lo:lo + keep] = pooled(net, part[lo:lo + keep])
    doc = combine(f, first)
    p = 1 / (1 + np.exp(-np.clip(doc @ net.out + net.last[0], -30, 30)))
    loss = -float(np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))
    g = ((p - y) / len(y)).astype(f.dtype)
    g_doc = g[:, None] * net.out
    n = np.diff(np.append(first, len(f)))
    of = np.repeat(np.arange(len(texts)), n)
    k = f.shape[1]
    best = f == doc[of, k:]
    share = np.add.reduceat(best, first).astype(f.dtype)[of]
    g_f = g_doc[of, :k] / n[of, None] + np.where(best, g_doc[of, k:] / share, 0)
    g_f = g_f * (f > 0)
    # only the place of the strongest response takes part
    c, j = np.nonzero(g_f)
    v = g_f[c, j]
    byte = part[c[:, None], at[c, j][:, None] * STRIDE + np.arange(WIDTH)]
    x = net.embed[byte].reshape(len(c), -1)
    g_filters = np.zeros_like(net.filters)
    np.add.at(g_filters.T, j, v[:, None] * x)
    g_embed = np.zeros_like(net.embed)
    np.add.at(g_embed, byte.ravel(), (v[:, None] * net.filters.T[j]).reshape(-1, EMBED))
    return loss, [g_embed, g_filters, g_f.sum(0), doc.T @ g, g.sum(keepdims=True)]


def train(texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 0) -> Net | None:
    """Adam over batches with as many documents of each class."""
    pools = [np.flatnonzero(y == c) for c in (0, 1)]
    if not all(map(len, pools)):
        return None
    rng = np.random.default_rng(seed)
    net = Net(*(rng.normal(0, s, shape).astype(np.float32) for s, shape in (
        (0.5, (256, EMBED)), (0.2, (WIDTH * EMBED, FILTERS)), (0.01, (FILTERS,)), (0.2, (2 * FILTERS,)), (0.01, (1,)))))
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, BATCH // 2) for p in pools])
        size = np.where(rng.random(len(pick)) < SHORT, rng.integers(*SHORT_BYTES, len(pick)), 1 << 30)
        _, grads = gradients(net, [texts[i][:n] for i, n in zip(pick, size.tolist(), strict=True)], y[pick].astype(np.float32))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample: int = SAMPLE) -> Net | None:
    rows = labelled(docs, labels, label_col, may_learn, sample, passage(PASSAGE, id_col, text_col), id_col)
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "t").collect()
    return train([r.t.encode() for r in got], np.array([int(r.y > 0) for r in got])) if got else None


def score(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                texts = [t or b"" for t in b.column(1).slice(lo, 256).to_pylist()]
                p = np.zeros(len(texts)) if net is None else probabilities(net, texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 256), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_texts(docs.select(docs[id_col].cast("long"), F.col(text_col).cast("binary")), run, "doc_id long, score double, predicted int")
