"""Benchmark decontamination: SimHash of item-sized windows over multi-index
Hamming blocks, then exact weighted-shingle similarity.

All on the main path is DataFrame expressions:

1. Words of documents and items (lower case, without ASCII punctuation) give
   five-word shingle hashes; an item of fewer words has one shingle, all its
   words, and documents then give shingles of that width too.  A window that
   shares no shingle with an item has similarity zero to it, so windows are taken
   where a document shares a shingle with an item.  Those placed so that the two
   shingles meet are all taken, as long as the item and cut at the text's ends; of
   all other windows as long as the item (a shorter text: the whole of it) those
   that hold enough shared shingles to be a match (``dense``; a bound, so none
   that matches is left out).
2. A window's SimHash is summed from its shingles, each weighted with its
   number of occurrences: 32 sums of two 32-bit counters each.
3. ``MAX_BITS + 1`` blocks of the 64 bits: two fingerprints at most ``MAX_BITS``
   apart agree in one block at least.  Windows meet the items that they share a
   shingle with in an equi-join over (item, block, bits of the block), which
   misses none within the radius.
4. Candidates within the radius are verified exactly: shared shingles, each as
   often as both have it, over all shingles of both.  0.8 or more is a match.

The radius: at similarity 0.8 a bit differs with a probability of 0.11 to 0.19
(most for an item of five shingles and a window cut to four of them), by the
exact binomials over all pairs of counts, so more than 29 of 64 bits differ in
less than one of a million pairs.  Repeated shingles weigh more; where two of
them have nearly all the weight, a bit differs with 0.25 at most, and more than
34 bits in less than one of a million.

The benchmark's side is written to the checkpoint folder and joined without
hints: the planner broadcasts it if its size allows, else it shuffles.

Defined results: null texts are empty; an item without words matches nothing, one
of fewer than five words each window with the same words; equal rows (id and
text) count once; null ids stay null; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage, row_key
from creditlake.llm.words import shingle_hashes, words

WIDTH = 5
SIMILARITY = 0.8
MAX_BITS = 34
#: Fixed value: the ASCII punctuation that is left out of words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WINDOW = ["key", "begin", "size", "item_size"]


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(rows[id_col].cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))


def _worded(keyed: DataFrame) -> DataFrame:
    """(id, key, w, n): the words of every row."""
    text = F.translate(F.lower("text"), PUNCTUATION, "")
    return keyed.select("id", "key", words(text).alias("w")).withColumn("n", F.size("w"))


def _shingles(worded: DataFrame, widths: list[int]) -> list[tuple[int, DataFrame]]:
    """(id, key, n, h) with the shingle hashes of every row, for each width."""
    return [(k, worded.select("id", "key", "n", shingle_hashes("w", k).alias("h"))) for k in widths]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fingerprint(counted: DataFrame, by: list[str]) -> DataFrame:
    """``by``, total (shingles with repeats) and fp of rows (by, h, c)."""
    two = 0x0000000100000001
    half = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(two)) * F.col("c")).alias(f"s{k}") for k in range(32)]
    sums = counted.groupBy(by).agg(F.sum("c").alias("total"), *half)
    low, high = (lambda k: F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))), (lambda k: F.shiftrightunsigned(f"s{k}", 32))
    bits = [F.when(2 * count(k) > F.col("total"), F.shiftleft(F.lit(1).cast("long"), k + shift)).otherwise(F.lit(0).cast("long"))
            for count, shift in ((low, 0), (high, 32)) for k in range(32)]
    # sums of eight bits, then of these: short expressions compile well
    parts = sums.select(*by, "total", *[_or(bits[i:i + 8]).alias(f"p{i}") for i in range(0, 64, 8)])
    return parts.select(*by, "total", _or([F.col(f"p{i}") for i in range(0, 64, 8)]).alias("fp"))


def _or(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out.bitwiseOR(c)
    return out


def _blocks(max_bits: int) -> Column:
    """The fingerprint's blocks, as an array of (block, bits)."""
    n = max_bits + 1
    cuts = [64 * b // n for b in range(n + 1)]
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << hi - lo) - 1)).alias("bits"))
                     for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])


def dense(hits: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, n, item, item_size, start): all starts of windows inside the text, as long as the item, that
    may be as similar as ``similarity``, from the ``hits`` of items of more than ``width`` words.

    An item of m shingles shares at least similarity * m of them with such a window,
    so this many hits (t) lie in m successive places.  Windows that hold the hits
    i to i + t - 1 start from the last one's place - (m - 1) to the first one's; those that the hit
    before lies in as well are its own."""
    held = hits.groupBy("key", "n", "item", "item_size").agg(F.sort_array(F.collect_set("p")).alias("at"))
    held = held.withColumn("m", F.col("item_size") - (width - 1)).withColumn("t", F.ceil(F.lit(similarity) * F.col("m") - 1e-9).cast("int"))

    def starts(i: Column) -> Column:
        first = F.get("at", i + F.col("t") - 1) - (F.col("m") - 1)
        first = F.greatest(first, F.when(i > 0, F.get("at", i - 1) + 1), F.lit(0))
        last = F.least(F.get("at", i), F.greatest(F.col("n") - F.col("item_size"), F.lit(0)))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    some = held.where(F.size("at") >= F.col("t")).select(
        "key", "n", "item", "item_size", F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("t")), starts)).alias("starts"))
    return some.select("key", "n", "item", "item_size", F.explode_outer("starts").alias("start")).where("start is not null")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, row_key, item_id, start_word, n_words, similarity, bits): the best window
    of each document and item with at least ``similarity``; of equals one where a shingle meets its
    own in the item, then the earliest.  Words are counted as in step 1."""
    items = _worded(_keyed(benchmark, item_col, item_text_col).dropDuplicates(["key"]))
    # outer, here and below: from an inner explode the optimizer infers filters that make the array again, for each element
    place = cut_lineage(_union([
        a.where(F.col("n") >= width if k == width else F.col("n") == k).select(
            F.col("id").alias("item_id"), F.col("key").alias("item"), F.col("n").alias("item_size"), F.lit(k).alias("width"), F.posexplode_outer("h").alias("q", "h"))
        for k, a in _shingles(items, list(range(1, width + 1)))]).where("h is not null"), "benchmark-shingles")
    item_counts = place.groupBy("item_id", "item", "item_size", "h").agg(F.count("*").alias("c"))
    item_prints = _fingerprint(item_counts, ["item_id", "item", "item_size"])
    # the widths that occur: five rows at most
    widths = sorted(r["width"] for r in place.select("width").distinct().collect()) or [width]

    keyed = _keyed(docs, id_col, text_col)
    anchors = place.select("h", "q", "item_size", "item", F.col("width").alias("k"))
    hits = cut_lineage(_union([
        a.select("key", "n", F.posexplode_outer("h").alias("p", "h")).join(anchors.where(F.col("k") == k), "h").select("key", "n", "p", "q", "item_size", "item")
        for k, a in _shingles(_worded(keyed), widths)]).distinct(), "benchmark-hits")
    starts = hits.select("key", "n", "item", "item_size", (F.col("p") - F.col("q")).alias("start"), F.lit(True).alias("meets")).unionByName(
        dense(hits.where(F.col("item_size") > width), width, similarity).withColumn("meets", F.lit(False)))
    begin = F.greatest("start", F.lit(0))
    end = F.least(F.col("start") + F.col("item_size"), F.col("n"))
    links = cut_lineage(starts.select("key", begin.alias("begin"), (end - begin).alias("size"), "item_size", "item", "meets").groupBy(*WINDOW, "item").agg(
        F.max("meets").alias("meets")), "benchmark-windows")
    windows = links.select(*WINDOW).distinct()

    # only the texts that hold a window are split again
    # (their keys are written: a table of keys is broadcast where one of all windows would make the texts be shuffled)
    holders = cut_lineage(links.select("key").distinct(), "benchmark-holders")
    again = keyed.join(holders, "key", "left_semi").dropDuplicates(["key"])
    inside = []
    for k, a in _shingles(_worded(again), widths):
        mine = windows.where(F.col("item_size") >= k if k == width else F.col("item_size") == k)
        h = F.slice("h", F.col("begin") + 1, F.col("size") - (k - 1))
        inside.append(a.join(mine, "key").select("id", *WINDOW, F.explode_outer(h).alias("h")))
    counted = cut_lineage(_union(inside).where("h is not null").groupBy("id", *WINDOW, "h").agg(F.count("*").alias("c")), "window-shingles")
    prints = _fingerprint(counted, WINDOW)

    w = links.join(prints, WINDOW).select(*WINDOW, "item", "meets", "total", "fp", F.inline(_blocks(max_bits)))
    i = item_prints.select("item_id", "item", F.col("total").alias("item_total"), F.col("fp").alias("item_fp"), F.inline(_blocks(max_bits)))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = w.join(i, ["item", "block", "bits"]).where(near <= max_bits).select(
        *WINDOW, "meets", "total", "item_id", "item", "item_total", near.alias("bits")).distinct()
    ic = item_counts.select("item", "h", F.col("c").alias("ic"))
    shared = pairs.join(counted, WINDOW).join(ic, ["item", "h"]).groupBy("id", *WINDOW, "meets", "total", "item_id", "item", "item_total", "bits").agg(
        F.sum(F.least("c", "ic")).alias("shared"))
    scored = shared.withColumn("sim", F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")))
    best = scored.where(F.col("sim") >= similarity).groupBy("id", "key", "item_id", "item").agg(
        F.max(F.struct("sim", "meets", (-F.col("begin")).alias("b"), "size", "bits")).alias("m"))
    return best.select(F.col("id").alias("doc_id"), F.col("key").alias("row_key"), "item_id", (-F.col("m.b")).cast("long").alias("start_word"),
                       F.col("m.size").cast("long").alias("n_words"), F.col("m.sim").alias("similarity"), F.col("m.bits").cast("int").alias("bits"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that match an item."""
    bad = cut_lineage(matches(docs, benchmark, id_col, text_col, **kw).select(F.col("row_key").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, row_key(id_col, text_col) == F.col("__bad"), "left_anti")


def oracle() -> str:
    """DuckDB SQL for the query's columns, from the similarity alone."""
    punct = PUNCTUATION.replace("'", "''")

    def split(table, key):
        return (f"SELECT DISTINCT {key}, text, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{punct}', ''), "
                rf"'[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM {table}")

    return rf"""
WITH d0 AS ({split('documents', 'doc_id')}), d AS (SELECT row_number() OVER () AS k, doc_id, ws, len(ws) AS n FROM d0),
i0 AS ({split('benchmark', 'item_id')}), i AS (SELECT row_number() OVER () AS item, item_id, ws, len(ws) AS item_size FROM i0 WHERE len(ws) > 0),
i2 AS (SELECT *, least(item_size, {WIDTH}) AS width FROM i),
ish AS (SELECT item, item_id, item_size, q - 1 AS q, list_slice(ws, q, q + width - 1) AS h FROM (SELECT *, unnest(range(1, item_size - width + 2)) AS q FROM i2)),
ic AS (SELECT item, h, count(*) AS ic FROM ish GROUP BY ALL),
dsh AS (SELECT k, n, width, p - 1 AS p, list_slice(ws, p, p + width - 1) AS h
        FROM (SELECT *, unnest(range(1, n - width + 2)) AS p FROM d, (SELECT DISTINCT width FROM i2) WHERE n >= width)),
win AS (SELECT DISTINCT k, greatest(p - q, 0) AS b, least(p - q + item_size, n) - greatest(p - q, 0) AS size, item_size
        FROM dsh JOIN (SELECT DISTINCT h, q, item_size FROM ish) USING (h)),
wc AS (SELECT k, b, size, item_size, h, count(*) AS c FROM win JOIN dsh USING (k)
       WHERE width = least(item_size, {WIDTH}) AND p >= b AND p < b + size - (width - 1) GROUP BY ALL),
sh AS (SELECT k, b, size, item_size, item, sum(least(c, ic)) AS s FROM wc JOIN ic USING (h) JOIN i2 USING (item, item_size) GROUP BY ALL),
sc AS (SELECT *, s / ((size - w1) + (item_size - w1) - s) AS sim FROM (SELECT *, least(item_size, {WIDTH}) - 1 AS w1 FROM sh)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, item ORDER BY sim DESC, b, size DESC) AS o FROM sc WHERE sim >= {SIMILARITY})
SELECT doc_id, item_id, CAST(b AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words, CAST(sim AS DOUBLE) AS similarity
FROM r JOIN d USING (k) JOIN i USING (item) WHERE o = 1"""
