"""Packing: order-preserving dynamic programming over window cuts.

Each input partition is a shard; its documents keep their order and form one
token stream.  Cuts are allowed at document ends (free), at sentence ends (a
small penalty) and, only where a stretch without any of these is longer than an
eighth of a window, at fixed steps inside it (a larger penalty).  The dynamic programme minimises padding plus penalties over
windows of at most ``max_len`` tokens.  Because a window's padding is linear in
its two ends, the best predecessor is a sliding-window minimum kept in a
monotone queue.  A shard is solved in blocks of ``block_windows`` windows, each
up to the cut near its end that loses least, so memory does not grow with the
shard.  The remainder at a shard's end is split into sequences
whose lengths are powers of two, which need no padding.

No shuffle: a lost task is rerun on the same partition.

Defined results: null text counts as empty; an empty document is the end id
alone; repeated rows are packed once each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import map_texts

MAX_LEN = 4096
END_ID = 2
#: What a cut inside a document costs, in padding tokens: at a sentence's end, or, in longer stretches than max_len / STRETCH, at steps of so many tokens.
SENTENCE_PENALTY = 8
STEP_PENALTY = 24
STEP = 32
STRETCH = 8
#: Text tokenised at a time.
TEXT_BYTES = 2_000_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

_SIMPLE = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Entries of a worker's word cache, each of at most _WORD_MAX bytes; it starts anew when full.
_CACHE_MAX, _WORD_MAX = 250_000, 40
_loaded: dict = {}


def _byte_alphabet() -> dict:
    """Byte-level BPE's rule: printable bytes stand for themselves, the others for the code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer(dict):
    """Token ids of whole texts through the vocabulary file, one blank-separated
    chunk at a time: a bounded cache from chunk to its ids (little-endian 32 bit).

    The vocabulary's pre-tokenizer drops white space and never joins across
    it, so chunks are independent.  Chunks of plain Latin letters, digits and
    ASCII signs are cut by the vocabulary's own pattern and handed to the model
    directly; any other chunk goes through the full tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tk = Tokenizer.from_file(path)
        self.model = self.tk.model
        self.alphabet = _byte_alphabet()
        #: By id: does the token end a sentence?
        self.stops = np.zeros(self.tk.get_vocab_size() + 1, np.bool_)
        self.stops[[k for t, k in self.tk.get_vocab().items() if t.removesuffix("</w>")[-1:] in (".", "!", "?")]] = True
        self[b""] = b""

    def __missing__(self, c: bytes) -> bytes:
        if c.isalpha():
            ids = self._ids(c.lower())
        elif (head := c[:-1]).isalpha() and c[-1] < 128 and not c[-1:].isdigit():
            return self[head] + self[c[-1:]]
        elif _SIMPLE.fullmatch(c) and b"<|" not in c:
            ids = b"".join([self[p] if p.isalpha() else self._ids(p) for p in map(str.encode, _PIECES.findall(c.decode().lower()))])
        else:
            ids = array("I", self.tk.encode(c.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(c) <= _WORD_MAX:
            if len(self) >= _CACHE_MAX:
                self.clear()
                self[b""] = b""
            self[c] = ids
        return ids

    def _ids(self, piece: bytes) -> bytes:
        piece = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and where each text's ids begin (and the last's end)."""
        # the vocabulary is lower case, but its special tokens count as they stand
        raw = pc.match_substring(texts, "<|")
        low = pc.ascii_lower(texts)
        if pc.any(raw).as_py():
            low = pc.if_else(raw, texts, low)
        words = pc.ascii_split_whitespace(low)
        each = words.values.dictionary_encode()
        ids = list(map(self.__getitem__, each.dictionary.cast(pa.binary()).to_pylist()))
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(size) - size
        word = each.indices.to_numpy(zero_copy_only=False)
        sizes = size[word]
        at = np.concatenate(([0], np.cumsum(sizes)))
        where = np.arange(at[-1]) + np.repeat(begin[word] - at[:-1], sizes)
        return np.frombuffer(b"".join(ids), "<u4")[where], at[words.offsets.to_numpy()]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def best_cuts(pos: list[int], pen: list[int], start: int, max_len: int, whole: bool = True) -> list[int]:
    """Cut positions with the least padding plus penalties.

    ``pos``: increasing cut candidates after ``start``, no gap over ``max_len``;
    ``pen``: their penalties.  ``whole``: the last cut is the last candidate;
    else it is that among the last ``max_len`` tokens up to which least is lost.
    """
    # padding sums to windows * max_len less the tokens, so a window adds max_len and its cut's penalty
    cost = [0]
    back = [-1]
    queue = deque([0])
    at = [start, *pos]
    for j, p in enumerate(pos, 1):
        while at[queue[0]] < p - max_len:
            queue.popleft()
        i = queue[0]
        c = cost[i] + max_len + pen[j - 1]
        back.append(i)
        cost.append(c)
        while queue and cost[queue[-1]] >= c:
            queue.pop()
        queue.append(j)
    j = len(pos)
    if not whole:
        near = bisect.bisect_right(at, at[-1] - max_len)
        j = min(range(max(near, 1), len(at)), key=lambda k: cost[k] - at[k])
    cuts = []
    while j > 0:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int, max_len: int) -> list[int]:
    """Cuts of a last, short window: powers of two while they save more padding than a cut costs."""
    cuts = []
    while end > start:
        n = end - start
        size = 1 << (n.bit_length() - 1)
        if n == size or max_len - n <= STEP_PENALTY:
            size = n
        start += size
        cuts.append(start)
    return cuts


class Packer:
    """Packs one stream of tokenised documents."""

    def __init__(self, max_len: int, first_id: int, block_windows: int = 64):
        self.max_len, self.block = max_len, block_windows * max_len
        self.docs: deque = deque()
        self.marks: list[np.ndarray] = []
        self.ends: list[int] = []
        self.done = self.total = 0
        self.next_id = first_id
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes, stops: np.ndarray) -> None:
        """stops: token counts at which a sentence ends inside the document, increasing."""
        n = len(ids) // 4
        self.docs.append((doc_id, ids, n, self.total))
        self.marks.append(stops + self.total)
        self.total += n
        self.ends.append(self.total)
        if self.total - self.done >= self.block:
            self._solve(False)

    def _candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions after the last cut, and the penalties of cutting there."""
        ends = np.asarray(self.ends)
        marks = np.union1d(np.concatenate(self.marks), ends)
        marks = marks[marks > self.done]
        gaps = np.diff(marks, prepend=self.done)
        steps = np.where(gaps > self.max_len // STRETCH, (gaps - 1) // STEP, 0)
        first = np.concatenate(([self.done], marks[:-1]))
        inner = np.repeat(first, steps) + STEP * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
        pos = np.concatenate((marks, inner))
        pen = np.concatenate((np.where(np.isin(marks, ends), 0, SENTENCE_PENALTY), np.full(len(inner), STEP_PENALTY)))
        order = np.argsort(pos)
        return pos[order], pen[order]

    def _solve(self, last: bool) -> None:
        if self.total == self.done:
            return
        pos, pen = self._candidates()
        cuts = best_cuts(pos.tolist(), pen.tolist(), self.done, self.max_len, False)
        if last:
            begin = [self.done, *cuts][-2]
            if self.total - begin <= self.max_len:  # the last window is the remainder
                cuts[-1:] = tail_cuts(begin, self.total, self.max_len)
            else:
                cuts += tail_cuts(cuts[-1], self.total, self.max_len)
        for c in cuts:
            self._emit(self.done, c)
            self.done = c
        self.marks = [pos[(pos > c) & (pen == SENTENCE_PENALTY)]]
        self.ends = [x for x in self.ends if x > c]

    def _emit(self, a: int, b: int) -> None:
        first = a
        while a < b:
            doc_id, ids, n, begin = self.docs[0]
            e = min(b, begin + n)
            lo, hi = a - begin, e - begin
            self.rows.append((doc_id, lo, hi - lo, zlib.crc32(ids[4 * lo:4 * hi]), n, self.next_id, a - first))
            if e == begin + n:
                self.docs.popleft()
            a = e
        self.next_id += 1

    def finish(self) -> None:
        self._solve(True)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each (a longer row stands alone), from the rows' running sizes."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of a document in a packed sequence (columns of ``SCHEMA``)."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(tokenizer_path)
        packer = Packer(max_len, TaskContext.get().partitionId() << 33)
        kinds = [pa.int64()] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            for lo, hi in slices(size, TEXT_BYTES):
                ids, at = tk.encode(texts.slice(lo, hi - lo))
                stops = np.flatnonzero(tk.stops[ids]) + 1
                of = np.searchsorted(stops, at, "right")
                for k in range(hi - lo):
                    packer.add(ids_of[lo + k], ids[at[k]:at[k + 1]].tobytes() + end, stops[of[k]:of[k + 1]] - at[k])
                if len(packer.rows) >= 8192:
                    yield out(packer.take())
        packer.finish()
        if packer.rows:
            yield out(packer.take())

    return map_texts(docs.select(docs[id_col].cast("long"), F.col(text_col)), run, SCHEMA)
