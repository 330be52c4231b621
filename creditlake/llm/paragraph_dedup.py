"""Substring dedup by MinHash banding of paragraphs.

Units of a text are its paragraphs (lines of at least ``MIN_WORDS`` words) and,
so that passages inside other lines are found too, the passages that begin at a
sentence's begin and run over whole sentences to at least that many words
(``MAX_PASSAGE`` at most), unless they are a paragraph.  Passages that begin
anywhere are found by winnowing: of every ``MIN_WORDS`` successive runs of
``MIN_WORDS`` words, the one of the least hash is a passage too.  Its place
depends on the words alone, so any run of ``2 MIN_WORDS - 1`` words that two
texts share holds a common passage.  Shorter lines of at least ``LINE_WORDS``
words, and whole texts of under ``MIN_WORDS`` words, are units of equal words too.

1. One pass cuts the units and hashes their words.  Paragraphs also get their
   set of five-word shingles and its MinHash signature in bands, which ``tune``
   chooses for the recall wanted at the similarity.  A passage has one band: its
   words in full.
2. Units of equal words form a class (aggregated before the shuffle, so copies
   of a unit never meet in one task).
3. Bands with several different paragraphs give candidates.  In each band the
   pairs of Jaccard similarity ``SIMILARITY`` or more are found exactly, by
   prefixes of the rarest shingles; a union-find takes them in, and only a
   spanning forest is emitted.  Bands of more than ``BLOCK`` different paragraphs
   are cut into blocks, each pair of which is a task of its own.
4. Connected components over the classes.  A component with units in two rows
   or more is a repetition: its first unit (smallest document id, then place)
   stays, the others are removals.

Defined results: words are lower-cased (A-Z) and parted by ASCII blanks; null
and empty texts have no unit; repeated rows repeat each other's units; null ids
stay null and come last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import components, cut_lineage, map_texts
from creditlake.llm.packing import slices

MIN_WORDS, MAX_PASSAGE, WIDTH = 25, 64, 5
LINE_WORDS = 6
SIMILARITY, RECALL, ROWS = 0.8, 0.995, 3
BLOCK = 20_000
TEXT_BYTES = 4_000_000
KINDS = ("paragraph", "passage", "line", "text")
#: A word that stands for a line's end (no text has it: a lone control sign between blanks is left as it is, as \\x01\\x01).
_LINE = "\x01"
_B1 = np.uint64(0x9E3779B97F4A7C15)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` rows by which a pair of ``similarity`` collides with probability ``recall``."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


_INVERSE = np.uint64(pow(int(_B1), -1, 1 << 64))


def shingles(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of ``WIDTH`` words, from the words' hashes."""
    n = len(h) - WIDTH + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(WIDTH):
        out = out * _B1 + h[k:k + max(n, 0)]
    return _mix(out)


def signature(x: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) keys of the MinHash bands of shingle sets that begin at ``first`` in ``x``."""
    seeds = _mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _B1)
    out = np.empty((len(first), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(first), np.uint64(b + 1))
        for r in range(rows):
            key = _mix(key * _B1 + np.minimum.reduceat(_mix(x ^ seeds[b * rows + r]), first))
        out[:, b] = key
    return out


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words: hash, ends a sentence?, line (numbered through); and where each text's words begin (and end)."""
    low = pc.replace_substring(pc.ascii_lower(texts), _LINE, _LINE + _LINE)
    low = pc.replace_substring(low, "\n", f" {_LINE} ")
    split = pc.ascii_split_whitespace(low)
    code = split.values.dictionary_encode()
    vocab = code.dictionary.cast(pa.binary()).to_pylist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in vocab], np.uint64)
    stop = np.array([w[-1:] in (b".", b"!", b"?") for w in vocab], np.bool_)
    mark, none = _LINE.encode(), np.array([w == b"" for w in vocab], np.bool_)
    is_mark = np.array([w == mark for w in vocab], np.bool_)
    c = code.indices.to_numpy(zero_copy_only=False)
    at = split.offsets.to_numpy()
    if not len(c):
        return np.zeros(0, np.uint64), np.zeros(0, np.bool_), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    begins = np.zeros(len(c) + 1, np.int64)
    np.add.at(begins, at[:-1], 1)  # a text begins a line too
    line = np.cumsum(begins[:-1]) + np.cumsum(is_mark[c])
    word = ~(is_mark[c] | none[c])
    offsets = np.concatenate(([0], np.cumsum(word)))[at]
    return h[c[word]], stop[c[word]], line[word], offsets


def units(h: np.ndarray, stop: np.ndarray, line: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of all paragraphs and passages, and which are paragraphs; places among all words."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.bool_)
    new_line = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    line_end = np.append(new_line[1:], n)
    long = line_end - new_line >= MIN_WORDS
    ends = np.unique(np.concatenate((np.flatnonzero(stop) + 1, line_end)))
    begin = np.concatenate(([0], ends[:-1]))
    doc_end = offsets[np.searchsorted(offsets, begin, "right")]
    end = ends[np.minimum(np.searchsorted(ends, begin + MIN_WORDS), len(ends) - 1)]
    end = np.minimum(np.minimum(end, begin + MAX_PASSAGE), doc_end)
    at = np.searchsorted(new_line, begin, "right") - 1
    paragraph = long[at] & (new_line[at] == begin) & (line_end[at] == end)
    fits = (end - begin >= MIN_WORDS) & ~paragraph
    return (np.concatenate((new_line[long], begin[fits])), np.concatenate((line_end[long], end[fits])),
            np.concatenate((np.ones(long.sum(), np.bool_), np.zeros(fits.sum(), np.bool_))))


def _slide(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """The minimum or maximum of every ``MIN_WORDS`` successive values."""
    have = 1
    while have < MIN_WORDS:
        step = min(have, MIN_WORDS - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def winnowed(key: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Begins of the runs of ``MIN_WORDS`` words with the least ``key`` of a window of as many
    successive runs (a text with fewer runs is one window); ``key`` has one value for each word's place."""
    k, n = MIN_WORDS, len(key)
    at = np.arange(n)
    doc = np.searchsorted(offsets, at, "right") - 1
    room = offsets[doc + 1] - at  # words up to the text's end
    worst, none = np.uint64(2**64 - 1), np.zeros(k - 1, np.uint64)
    key = np.where(room >= k, key, worst)
    least = _slide(np.concatenate((key, none + worst)), np.minimum)
    # a window lies in its text, whose runs end k - 1 places before the next text's begin
    least[~((room >= 2 * k - 1) | ((room >= k) & (at == offsets[doc])))] = 0
    found = np.flatnonzero((_slide(np.concatenate((none, least)), np.maximum) == key) & (room >= k))
    # of equal runs close together as many as leave one in each window
    same = np.concatenate(([False], (key[found[1:]] == key[found[:-1]]) & (found[1:] - found[:-1] < k)))
    if not same.any():
        return found
    out: list[int] = []
    kept = 0
    for i, (b, tied) in enumerate(zip(found.tolist(), same.tolist(), strict=True)):
        more = i + 1 < len(found) and same[i + 1]
        if not tied or not more or found[i + 1] - kept > k:
            out.append(b)
            kept = b
    return np.array(out, np.int64)


def short(line: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) of the lines of ``LINE_WORDS`` words or more and the whole texts that have under ``MIN_WORDS``, and which are whole texts."""
    new_line = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))[:len(line)])
    begin = np.concatenate((new_line, offsets[:-1]))
    size = np.concatenate((np.diff(np.append(new_line, len(line))), np.diff(offsets)))
    least = np.repeat([LINE_WORDS, 1], [len(new_line), len(offsets) - 1])
    at = np.unique(np.stack((begin, size))[:, (size >= least) & (size < MIN_WORDS)], axis=1)
    doc = np.searchsorted(offsets, at[0], "right") - 1
    return at[0], at[0] + at[1], at[1] == np.diff(offsets)[doc]


def _cut(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """(uid, doc_id, begin, size, kind, words, bands, shingles): every unit; the last two of paragraphs only."""
    schema = "uid long, doc_id long, begin int, size int, kind byte, words long, bands array<long>, shingles array<int>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).fill_null("")
            size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            for lo, hi in slices(size, TEXT_BYTES):
                h, stop, line, offsets = words_of(texts.slice(lo, hi - lo))
                begin, end, whole = units(h, stop, line, offsets)
                # of a run of words: sum of hash * base**place, shifted back to the run's begin
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _power(len(h), _B1))))
                back = _power(len(h), _INVERSE)
                more = winnowed(_mix((sums[np.minimum(np.arange(len(h)) + MIN_WORDS, len(h))] - sums[:-1]) * back + np.uint64(MIN_WORDS)), offsets)
                more = np.setdiff1d(more, begin[end - begin == MIN_WORDS])
                b0, e0, is_text = short(line, offsets)
                kind = np.concatenate((np.where(whole, 0, 1), np.ones(len(more), np.int64), np.where(is_text, 3, 2))).astype(np.int8)
                begin, end = np.concatenate((begin, more, b0)), np.concatenate((end, more + MIN_WORDS, e0))
                whole = kind == 0
                if not len(begin):
                    continue
                doc = np.searchsorted(offsets, begin, "right") - 1
                key = _mix((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))
                x = shingles(h)
                many = (end - begin)[whole] - WIDTH + 1
                first = np.cumsum(many) - many
                place = np.arange(many.sum()) + np.repeat(begin[whole] - first, many)
                keys = signature(x[place], first, bands, rows).view(np.int64) if len(first) else np.zeros((0, bands), np.int64)
                small = (x[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                n, k = len(begin), len(first)
                none = np.zeros(n - k, np.int64)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(doc + lo)), b.column(1).take(pa.array(doc + lo)),
                    pa.array((begin - offsets[doc]).astype(np.int32)), pa.array((end - begin).astype(np.int32)), pa.array(kind), pa.array(key.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(k + 1) * bands, none + k * bands)).astype(np.int32)), pa.array(keys.ravel())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate((first, [many.sum()], none + many.sum())).astype(np.int32)), pa.array(small))], names)

    return map_texts(docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].cast("long"), F.col(text_col).cast("string")), run, schema)


def similar(keys: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest (as pairs of keys) of the pairs of sets with at least this Jaccard similarity.

    A pair that similar shares one of the first n - ceil(similarity n) + 1 shingles
    of each, in any one order; rarest first leaves few candidates.  Pairs already
    connected aren't verified, and a posting list is kept by component, so a large
    group of similar texts takes time in proportion to its size.
    """
    if len(sets) < 2:
        return []
    sets = [np.unique(s) for s in sets]
    every, count = np.unique(np.concatenate(sets), return_counts=True)
    up = list(range(len(sets)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    posting: dict = defaultdict(lambda: defaultdict(list))
    edges = []
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), keys[i])):
        s = sets[i]
        n = len(s)
        df = count[np.searchsorted(every, s)]
        need = int(np.ceil(similarity * n - 1e-9))
        prefix = s[np.lexsort((s, df))][:n - need + 1]
        prefix = [x for x, c in zip(prefix.tolist(), np.sort(df)[:n - need + 1].tolist(), strict=True) if c > 1]
        tried = set()
        for x in prefix:
            for root, members in list(posting[x].items()):
                for j in members:
                    if find(root) == find(i):
                        break
                    if j in tried or len(sets[j]) < similarity * n - 1e-9:
                        continue
                    tried.add(j)
                    both = len(np.intersect1d(s, sets[j], assume_unique=True))
                    if both >= similarity * (n + len(sets[j]) - both) - 1e-9:
                        edges.append((keys[i], keys[j]))
                        up[find(i)] = find(j)
        for x in prefix:
            posting[x][find(i)].append(i)
    return edges


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
             recall: float = RECALL) -> DataFrame:
    """(doc_id, uid, start_word, n_words, kind, component_id, component_units, removed): every unit of the
    components that have units in two rows or more; ``kind`` is one of ``KINDS``."""
    spark = docs.sparkSession
    bands = tune(similarity, recall)
    every = cut_lineage(_cut(docs, id_col, text_col, bands, ROWS), "paragraph-units")
    # counts shuffle as next to nothing beside their keys; units that repeat in one row alone go again at the end
    copied = every.groupBy("words").agg(F.count("*").alias("n")).where("n > 1").select("words")

    lines = every.where(F.size("bands") > 0)
    banded = lines.select("words", F.explode_outer("bands").alias("band"))
    # several different texts in a band
    crowded = banded.groupBy("band").agg(F.min("words").alias("w0"), F.max("words").alias("w1")).where("w0 <> w1").select("band")
    crowded = cut_lineage(crowded, "crowded-bands")
    members = cut_lineage(banded.join(crowded, "band", "left_semi").distinct(), "band-members")
    texts = lines.select("words", "shingles").join(members.select("words").distinct(), "words", "left_semi").groupBy("words").agg(
        F.min("shingles").alias("shingles"))  # equal words have equal shingles
    blocks = members.groupBy("band").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int")
    cells = members.join(blocks, "band").select("band", "words", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    cells = cells.select("band", "words", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(texts, "words")

    def link(group: pa.Table) -> pa.Table:
        got = similar(group.column("words").to_pylist(), [np.asarray(s.as_py(), np.int32) for s in group.column("shingles")], similarity)
        return pa.table({"a": pa.array([a for a, _ in got], pa.int64()), "b": pa.array([b for _, b in got], pa.int64())})

    edges = cells.groupBy("band", "i", "j").applyInArrow(link, "a long, b long")
    roots = components(cut_lineage(edges.distinct(), "paragraph-links"))
    # classes that repeat by themselves or are linked; the others are single
    named = copied.join(roots, copied["words"] == roots["node"], "full").select(
        F.coalesce("words", "node").alias("words"), F.coalesce("root", "words").alias("root"))
    found = cut_lineage(every.select("uid", "doc_id", "begin", "size", "kind", "words").join(named, "words").drop("words"), "repeated-units")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid", "begin", (-F.col("size")).alias("s"))
    first = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("component_units"),
                                      F.min("uid").alias("u0"), F.max("uid").alias("u1")).where("u0 < u1")
    # written, so that the join below stands alone and a component with many units can be split
    first = cut_lineage(first, "repeated-components")
    return found.join(first, "root").select(
        "doc_id", "uid", F.col("begin").cast("long").alias("start_word"), F.col("size").cast("long").alias("n_words"),
        F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("kind"),
        F.col("root").alias("component_id"), "component_units",
        ((F.col("uid") != F.col("first.uid")) | (F.col("begin") != F.col("first.begin"))).alias("removed"))
