"""Fill-in-middle transformation over seekable compressed frames.

1. ``store`` cuts each text into independent zstandard frames of
   ``FRAME_BYTES`` bytes (and the rest of a code point), and keeps beside them how many units and code points
   stand before each frame.  A unit is a run of ASCII letters or any other code
   point (``[A-Za-z]+|[^A-Za-z]``).  A frame may end inside a unit, which counts
   where it begins, so frames are bounded whatever the text holds.
2. ``transform`` draws the two cuts and the form from the document's id, finds
   the cut frames by bisecting the counts, and decompresses these alone to turn
   units into places.  The output is written as frames again, one after the other.
3. ``digests`` streams the output's frames into a digest, and rebuilds the text
   from output and form alone: it looks for the marks in the stream and
   replays the three parts in the text's order into a second digest.

No step holds more than one frame uncompressed beside the frames' bytes; nothing
is shuffled.  The stored frames are written to the shared folder once.

Defined results: a null text is empty; an empty text, and one that holds a mark,
stays plain; a null id counts as the empty text in the draw; repeated rows give
equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage, map_texts

FRAME_BYTES = 1 << 16
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20  # of 100
PRE, SUF, MID = b"<P>", b"<S>", b"<M>"

FRAMES = "doc_id long, marked boolean, units array<long>, chars array<long>, frames array<binary>"
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>"


def begins(raw: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes of a text: where code points begin, and where units begin.
    ``after_letter``: the byte before the first is a letter."""
    letter = ((raw | 32) - np.uint8(97)) < 26
    point = (raw & 0xC0) != 0x80
    before = np.empty_like(letter)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    return point, point & ~(letter & before)


def frames_of(text: bytes, frame_bytes: int = FRAME_BYTES) -> tuple[list[bytes], list[int], list[int]]:
    """(frames, units before each and in all, code points before each and in all)."""
    pack = zstandard.ZstdCompressor(level=3).compress
    frames, units, chars = [], [0], [0]
    lo, after = 0, False
    while lo < len(text):
        hi = min(lo + frame_bytes, len(text))
        while hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi += 1  # a code point isn't parted
        part = text[lo:hi]
        point, unit = begins(np.frombuffer(part, np.uint8), after)
        frames.append(pack(part))
        units.append(units[-1] + int(unit.sum()))
        chars.append(chars[-1] + int(point.sum()))
        after = part[-1:].isalpha()
        lo = hi
    return frames, units, chars


def sizes(frames: list[bytes]) -> list[int]:
    """Bytes of the text before each frame and in all, as the frames' headers say."""
    out = [0]
    for f in frames:
        out.append(out[-1] + zstandard.frame_content_size(f))
    return out


def stream(frames: list[bytes], at: list[int], lo: int, hi: int) -> Iterator[bytes]:
    """The bytes from ``lo`` to ``hi``, a frame at a time; other frames stay compressed."""
    k = max(bisect_right(at, lo) - 1, 0)
    unpack = zstandard.ZstdDecompressor().decompress
    while k < len(frames) and at[k] < hi:
        part = unpack(frames[k])
        yield part[max(lo - at[k], 0):hi - at[k]]
        k += 1


def place(k: int, frames: list[bytes], at: list[int], units: list[int], chars: list[int]) -> tuple[int, int]:
    """(bytes, code points) before unit ``k``; behind the last unit, those of the whole text."""
    if k >= units[-1]:
        return at[-1], chars[-1]
    f = bisect_right(units, k) - 1
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frames[f]), np.uint8)
    point, unit = begins(raw, False)
    if int(unit.sum()) > units[f + 1] - units[f]:  # the frame begins inside a unit
        unit[0] = False
    b = int(np.flatnonzero(unit)[k - units[f]])
    return at[f] + b, chars[f] + int(point[:b].sum())


def draw(doc_id, seed: int = SEED) -> list[int]:
    """Four unsigned 32-bit numbers from the document's id."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]


def reframe(parts: Iterable[bytes], frame_bytes: int = FRAME_BYTES) -> list[bytes]:
    """The parts, one after the other, as frames."""
    pack = zstandard.ZstdCompressor(level=3).compress
    out, held = [], bytearray()
    for p in parts:
        held += p
        while len(held) >= frame_bytes:
            out.append(pack(bytes(held[:frame_bytes])))
            del held[:frame_bytes]
    if held:
        out.append(pack(bytes(held)))
    return out


def parts_of(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The text, rebuilt from an output and its form: prefix, middle, suffix."""
    at = sizes(frames)
    if form == "plain":
        yield from stream(frames, at, 0, at[-1])
        return
    first, second = (PRE, SUF) if form == "psm" else (SUF, PRE)
    found, wanted, tail, done = [], [first, second, MID], b"", 0
    for part in stream(frames, at, 0, at[-1]):
        held = tail + part
        i = 0
        while len(found) < 3 and (j := held.find(wanted[len(found)], i)) >= 0:
            found.append(done - len(tail) + j)
            i = j + 3
        done += len(part)
        # a mark may stand across frames; what a found mark has used up isn't seen again
        tail = held[max(i, len(held) - 2):]
    a, b, c = found
    one, two, three = (a + 3, b), (b + 3, c), (c + 3, at[-1])
    for lo, hi in ((one, three, two) if form == "psm" else (two, three, one)):
        yield from stream(frames, at, lo, hi)


def _rows(fn, schema: str):
    """A ``mapInArrow`` function that calls ``fn`` for each row (as a tuple of Python values)."""
    names, kinds = zip(*((f.split()[0], ARROW[f.split()[1]]) for f in schema.split(", ")), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fn(*(c[i].as_py() for c in b.columns)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], list(names))

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, marked, units, chars, frames): every text as frames with cumulative counts."""

    def one(doc_id, text):
        text = text or b""
        frames, units, chars = frames_of(text, frame_bytes)
        return doc_id, any(m in text for m in (PRE, SUF, MID)), units, chars, frames

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string").cast("binary"))
    return map_texts(rows, _rows(one, FRAMES), FRAMES)


def transform(stored: DataFrame, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, frames): every output, as frames."""

    def one(doc_id, marked, units, chars, frames):
        n, at = units[-1], sizes(frames)
        h1, h2, h3, h4 = draw(doc_id, seed)
        if n == 0 or marked or h3 % 100 >= plain_from:
            return doc_id, n, "plain", None, None, frames
        form = "spm" if h4 % 100 < spm_below else "psm"
        (a, a_chars), (b, b_chars) = (place(k, frames, at, units, chars) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = ((lambda lo=lo, hi=hi: stream(frames, at, lo, hi)) for lo, hi in ((0, a), (a, b), (b, at[-1])))

        def parts():
            order = ((PRE, prefix), (SUF, suffix)) if form == "psm" else ((SUF, suffix), (PRE, prefix))
            for mark, part in (*order, (MID, middle)):
                yield mark
                yield from part()

        return doc_id, n, form, a_chars, b_chars - a_chars, reframe(parts(), frame_bytes)

    return map_texts(stored.select("doc_id", "marked", "units", "chars", "frames"), _rows(one, OUTPUT), OUTPUT)


def digests(outputs: DataFrame) -> DataFrame:
    """The outputs with the SHA-256 of each and of the text rebuilt from it, instead of the frames."""
    schema = OUTPUT.replace("frames array<binary>", "output_sha256 string, restored_sha256 string")

    def one(doc_id, n, form, prefix_chars, middle_chars, frames):
        at = sizes(frames)
        out, back = hashlib.sha256(), hashlib.sha256()
        for p in stream(frames, at, 0, at[-1]):
            out.update(p)
        for p in parts_of(frames, form):
            back.update(p)
        return doc_id, n, form, prefix_chars, middle_chars, out.hexdigest(), back.hexdigest()

    return map_texts(outputs, _rows(one, schema), schema)


def texts(outputs: DataFrame) -> DataFrame:
    """(doc_id, form, output): the outputs as plain text."""

    def one(doc_id, form, frames):
        at = sizes(frames)
        return doc_id, form, b"".join(stream(frames, at, 0, at[-1])).decode()

    schema = "doc_id long, form string, output string"
    return map_texts(outputs.select("doc_id", "form", "frames"), _rows(one, schema), schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Store the texts as frames below the shared folder and transform them from there."""
    return transform(cut_lineage(store(docs, id_col, text_col), "fim-frames"), **kw)


def oracle() -> str:
    """DuckDB SQL of the digests; DuckDB's regular expressions work on code points as well."""
    return f"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
c AS (SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
    WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
