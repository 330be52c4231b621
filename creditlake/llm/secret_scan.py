"""Secret scans: three fixed patterns, and sliding-window entropy.

Beside the patterns (``assign``, ``access``, ``hex``), every run of at least a
class's window of characters is scanned for windows of high Shannon entropy.
Counts are updated by the character that enters and the one that leaves, so a
run costs time in proportion to its length.  Windows over the class's threshold
that overlap or touch become one span of kind ``entropy``.  The allow-list
suppresses windows, not runs: those that overlap a placeholder or a UUID are left
out, and so are found stretches that are words, numbers or dates, or that stand in
a URL's host or path.  It never suppresses the patterns.

One pass (``mapInArrow``), no shuffle.  Defined results: null texts are empty;
whole texts are scanned, a row at a time; repeated rows get a row each; an empty
table gives none; other columns are ignored (``redact`` passes them on).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import map_texts

# The patterns, their least lengths and the order of kinds.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Any access or hex match and any entropy window lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


class CharClass(NamedTuple):
    """Runs of ``chars`` are scanned by windows of ``window`` characters for at least ``bits`` of entropy a character."""
    name: str
    chars: re.Pattern
    window: int
    bits: float


#: A random window has about 3.4 bits (hex of 24), 3.9 (small letters and digits) or 4.1 (base 64 of 20); the allow-list knows words.
CLASSES = (
    CharClass("hex", re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0),
    CharClass("upper", re.compile(r"[A-Z0-9]{16,}"), 16, 3.2),
    CharClass("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.4),
)
#: Windows that overlap one of these are left out.
KNOWN = re.compile(r"(?i:example|placeholder|changeme|xxxx|0000|1234567)"
                   r"|(?<![A-Za-z0-9])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![A-Za-z0-9])")
#: Numbers and dates.
NUMBERS = re.compile(r"[0-9_/+=-]*")
#: What stands before a part of a URL's user, host or path (query and fragment are no such part).
URL = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)([^\s?#]*)$", re.IGNORECASE)
#: The rest of a URL's user part, with its end.
USER = re.compile(r"[^\s/?#@]*@")
#: Words have at most one letter in so many that is a capital inside a word and starts none.
CAPITALS = 8
#: ... and their parts of one case or with a capital first have this many letters on average.
PART_LETTERS = 3
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: A capital behind a letter, without two small letters behind it.
INNER = re.compile(r"(?<=[A-Za-z])[A-Z](?![a-z][a-z])")
_CLOG = [0.0, *(c * log2(c) for c in range(1, 64))]


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself starts


def hot_windows(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Maximal unions of windows of ``s`` with at least ``bits`` bits a character."""
    # with c the counts in a window of w characters: entropy = log2(w) - sum(c log2 c) / w
    most = (log2(window) - bits) * window + 1e-9
    counts: dict = {}
    total, out = 0.0, []
    for k, ch in enumerate(s):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _CLOG[c + 1] - _CLOG[c]
        if k >= window:
            old = s[k - window]
            c = counts[old]
            counts[old] = c - 1
            total += _CLOG[c - 1] - _CLOG[c]
        if k >= window - 1 and total <= most:
            a = k - window + 1
            if out and a <= out[-1][1]:
                out[-1] = out[-1][0], k + 1
            else:
                out.append((a, k + 1))
    return out


def wordlike(s: str) -> bool:
    """No digits, and no letters of random case."""
    if any(c.isdigit() for c in s):
        return False
    letters = sum(c.isalpha() for c in s)
    return s.upper() == s or (len(INNER.findall(s)) * CAPITALS <= letters and len(PART.findall(s)) * PART_LETTERS <= letters)


def allowed(text: str, start: int, end: int) -> bool:
    """Is the stretch made of words or numbers, or part of a URL's host or path?"""
    s = text[start:end]
    if wordlike(s) or NUMBERS.fullmatch(s):
        return True
    s = s.lstrip("/")
    start = end - len(s)
    url = URL.search(text, max(0, start - 300), start)
    # before the first slash, what an @ follows is the user part
    return bool(url) and ("/" in url[1] + s or not USER.match(text, end, end + 300))


def unknown(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a run between what ``KNOWN`` matches: windows inside them overlap none of it."""
    at = start
    for m in KNOWN.finditer(text, start, end):
        yield at, m.start()
        at = m.end()
    yield at, end


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and non-overlapping for each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            if run.end() - run.start() >= LEAST[kind]:
                out += [Span(kind, m.start(), m.end(), m.start()) for m in pattern.finditer(text, run.start(), run.end()) if m.end() - m.start() >= LEAST[kind]]
    return _sorted(out)


def entropy_spans(text: str) -> list[Span]:
    found: list[tuple[int, int]] = []
    for run in RUN.finditer(text):
        for cls in CLASSES:
            for m in cls.chars.finditer(text, run.start(), run.end()):
                for lo, hi in unknown(text, m.start(), m.end()):
                    hot = hot_windows(text[lo:hi], cls.window, cls.bits)
                    found += [(lo + a, lo + b) for a, b in hot if not allowed(text, lo + a, lo + b)]
    out: list[Span] = []
    for a, b in sorted(found):
        if out and a <= out[-1].end:
            out[-1] = Span("entropy", out[-1].start, max(b, out[-1].end), out[-1].start)
        else:
            out.append(Span("entropy", a, b, a))
    return out


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """(the patterns' spans, all spans)."""
    base = base_spans(text or "")
    return base, _sorted(base + entropy_spans(text or ""))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans) of every row."""
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_spans string, spans string"
    names = [x.split()[0] for x in kinds.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                base, every = scan(b.column(1)[i].as_py())
                n = [sum(s.kind == k for s in every) for k in KINDS]
                rows.append((*n, joined(base), joined(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds_of, strict=True))], names)

    return map_texts(docs.select(docs[id_col].cast("long"), F.col(text_col).cast("string")), run, kinds)


def digest(spans: str | None) -> str:
    return hashlib.sha256((spans or "").encode()).hexdigest()


def mask(text: str, mark: str = "[SECRET]") -> str:
    """``text`` with the secrets of all spans replaced."""
    out, at = [], 0
    for a, b in sorted((s.value, s.end) for s in scan(text)[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` masked; ``length_col``, if there is one, is the new length of changed texts."""
    text_at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            old = cols[text_at].to_pylist()
            new = [t if t is None else mask(t) for t in old]
            cols[text_at] = pa.array(new, cols[text_at].type)
            if length_at is not None:
                was = cols[length_at]
                size = [was[i].as_py() if n == t else len(n) for i, (t, n) in enumerate(zip(old, new, strict=True))]
                cols[length_at] = pa.array(size, was.type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return map_texts(docs, run, docs.schema)
