"""Language identification by a bidirectional gated recurrent network over bytes.

Every byte is labelled: two recurrences (forward and backward) run over
segments of ``SEGMENT`` bytes that cover the whole text, and a softmax over
both states gives the languages' probabilities at each position.  A document's
probabilities are the means over its letters' positions.  The gates are
piecewise linear (clipped), so a step is a few additions, products and clips.

Trained in numpy by backpropagation through time, on passages of a bounded
sample (``SAMPLE`` documents, ``PASSAGE`` characters each) with a fixed number
of steps; the weights (a few thousand numbers) go to the tasks.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is any if there was nothing to learn from; whole texts are read; repeated
rows get a row each; an empty table gives none; other columns are ignored
(``recognised`` passes them on).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import crc_bucket, cut_lineage, map_texts, row_key
from creditlake.llm.sampling import among, passage

#: Documents learnt from, at most, and characters of each.
SAMPLE, PASSAGE = 2000, 512
SEGMENT, HIDDEN, STEPS, BATCH, RATE = 128, 8, 250, 64, 0.02
UNKNOWN, MIN_SCORE = "und", 0.3
#: Bytes labelled at a time.
SLICE = 1 << 18
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_ASCII = re.compile(rb"[A-Za-z]")


class Net(NamedTuple):
    """x: (3, 512, h), what a byte adds to the update gate, the reset gate and the candidate (forward bytes, then backward);
    u: (3, 2, h, h); out: (2h, k); bias: (k,)."""
    langs: tuple
    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]


def _forward(net: Net, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (t, 2, n, h) over segments ``seq`` (n, t); the backward ones stand at the step they were made in."""
    n, t = seq.shape
    h = np.zeros((2, n, net.u.shape[-1]), np.float32)
    states = np.empty((t, *h.shape), np.float32)
    both = np.stack((seq, seq[:, ::-1].astype(np.int64) + 256)).astype(np.int64)
    for k in range(t):
        at = both[:, :, k]
        z = np.matmul(h, net.u[0])
        z += net.x[0][at]
        z += 0.5
        np.clip(z, 0, 1, out=z)
        r = np.matmul(h, net.u[1])
        r += net.x[1][at]
        r += 0.5
        np.clip(r, 0, 1, out=r)
        c = np.matmul(h, net.u[2])
        m = r * c
        m += net.x[2][at]
        np.clip(m, -1, 1, out=m)
        new = h - m
        new *= z
        new += m
        if keep is not None:
            keep.append((at, h, z, r, c, m))
        states[k] = h = new
    return states


def _probabilities(net: Net, states: np.ndarray) -> np.ndarray:
    """(t, n, k) at each position."""
    hid = net.u.shape[-1]
    logits = states[:, 0] @ net.out[:hid]
    logits += states[::-1, 1] @ net.out[hid:]
    logits += net.bias
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def gradients(net: Net, seq: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss (cross-entropy over positions, weighted (n, t)) and gradients of ``net.params()``."""
    hid = net.u.shape[-1]
    keep: list = []
    states = _forward(net, seq, keep)
    p = _probabilities(net, states)
    w = (weight.T / max(weight.sum(), 1e-9)).astype(p.dtype)
    loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), 2)[..., 0] + 1e-12) * w).sum())
    d = p.copy()
    np.put_along_axis(d, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), np.take_along_axis(d, np.broadcast_to(y[None, :, None], (*p.shape[:2], 1)), 2) - 1, 2)
    d *= w[..., None]
    flat = d.reshape(-1, d.shape[-1])
    g_out = np.concatenate((states[:, 0].reshape(-1, hid).T @ flat, np.ascontiguousarray(states[::-1, 1]).reshape(-1, hid).T @ flat))
    d_h = np.stack((d @ net.out[:hid].T, (d @ net.out[hid:].T)[::-1]), 1)
    g_x, g_u = np.zeros_like(net.x), np.zeros_like(net.u)
    carry = np.zeros_like(keep[0][1])
    back = np.swapaxes(net.u, -1, -2)
    for k in range(len(keep) - 1, -1, -1):
        at, h, z, r, c, m = keep[k]
        dh = carry + d_h[k]
        dz = dh * (h - m) * ((z > 0) & (z < 1))
        dm = dh * (1 - z) * ((m > -1) & (m < 1))
        dr = dm * c * ((r > 0) & (r < 1))
        dc = dm * r
        carry = dh * z + np.matmul(dz, back[0]) + np.matmul(dr, back[1]) + np.matmul(dc, back[2])
        ht = np.swapaxes(h, -1, -2)
        for i, (gate, inner) in enumerate(((dz, dz), (dr, dr), (dm, dc))):
            g_u[i] += np.matmul(ht, inner)
            np.add.at(g_x[i], at, gate)
    return loss, [g_x, g_u, g_out, flat.sum(0)]


def _segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into segments (n, SEGMENT), zero-padded, and each segment's text."""
    need = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
    if not need.sum():
        return np.zeros((0, SEGMENT), np.uint8), np.zeros(0, np.int64)
    data = b"".join(t.ljust(k * SEGMENT, b"\0") for t, k in zip(texts, need.tolist(), strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, SEGMENT), np.repeat(np.arange(len(texts)), need)


def train(texts: list[bytes], langs: list[str], steps: int = STEPS, seed: int = 0) -> Net | None:
    """Adam on random batches of segments, each language equally often."""
    names = tuple(sorted(set(langs)))
    seq, of = _segments(texts)
    weight = _LETTER[seq].astype(np.float32)
    some = weight.sum(1) >= 4
    seq, of, weight = seq[some], of[some], weight[some]
    y = np.array([names.index(x) for x in langs], np.int64)[of]
    if not len(seq):
        return None
    rng = np.random.default_rng(seed)
    k, h = len(names), HIDDEN
    net = Net(names, rng.normal(0, 0.3, (3, 512, h)).astype(np.float32), rng.normal(0, 0.3, (3, 2, h, h)).astype(np.float32),
              rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32))
    pools = [np.flatnonzero(y == c) for c in range(k)]
    pools = [p for p in pools if len(p)]
    first, second = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(p, max(1, BATCH // len(pools))) for p in pools])
        _, grads = gradients(net, seq[pick], y[pick], weight[pick])
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
            g = g / max(1.0, norm)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def label(net: Net, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): mean probabilities over the positions of letters."""
    total = np.zeros((len(texts), len(net.langs)))
    seq, of = _segments(texts)
    step = max(1, SLICE // SEGMENT)
    for lo in range(0, len(seq), step):
        part = seq[lo:lo + step]
        p = _probabilities(net, _forward(net, part))
        np.add.at(total, of[lo:lo + step], np.einsum("tnk,nt->nk", p, _LETTER[part].astype(np.float32)))
    return total / np.maximum(total.sum(1, keepdims=True), 1e-9)


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ASCII.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace")))))


def predict(net: Net | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    known = [net is not None and has_letter(t) for t in texts]
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    p = label(net, [t if k else b"" for t, k in zip(texts, known, strict=True)])
    best = p.argmax(1)
    return ([net.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)],
            [float(min(1.0, x[b])) if k else 0.0 for x, b, k in zip(p, best, known, strict=True)])


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE) -> Net | None:
    """Learns from ``sample`` rows (with a language and a text, by the rows' hashes) that ``may_learn`` admits."""
    some = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & may_learn)
    key = row_key(id_col, text_col)
    # equal rows pass together, so different ones are counted; their copies are left out before the sort
    few = among(key, some.agg(F.approx_count_distinct(key)).first()[0], sample)
    rows = some.where(few).select(key.alias("o"), passage(PASSAGE, id_col, text_col).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    got = cut_lineage(rows.distinct().orderBy("o", "t", "lang").limit(sample), "language-sample").orderBy("o", "t", "lang").collect()
    return train([r.t.encode() for r in got], [r.lang for r in got]) if got else None


def identify(docs: DataFrame, net: Net | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                lang, score = predict(net, b.column(1).slice(lo, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 512), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_texts(docs.select(docs[id_col].cast("long"), F.col(text_col).cast("binary")), run, "doc_id long, lang_pred string, score double")


def learnable(id_col: str = "doc_id") -> Column:
    return crc_bucket(id_col, 4) != 2


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is unknown or scores under ``min_score``."""
    net = fit(docs, learnable(id_col), id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                lang, score = predict(net, [None if t is None else t.encode() for t in part.column(at).to_pylist()])
                yield part.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return map_texts(docs, run, docs.schema)
