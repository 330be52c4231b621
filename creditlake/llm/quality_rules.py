"""Quality rules: a threshold table compiled into one projection.

``MEASURES`` are expressions over a text's words and lines, ``RULES`` bounds on
them; ``judge`` turns both into columns of one narrow Spark stage, without user
functions and without a shuffle.

Defined results: a null text has no words, characters or lines; rows are judged
one by one, so repeated rows get a row each; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake.llm.words import BLANKS, shingle_hashes, words

# Signs that count as symbols, and frequent function words of English, German, French and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = sorted({
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "this", "from", "or", "an", "a", "at", "not",
    "der", "die", "das", "und", "ist", "nicht", "mit", "den", "von", "zu", "ein", "eine", "auf", "für", "des", "dem", "im", "sich",
    "le", "la", "les", "de", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "sur", "au", "par", "pas",
    "el", "los", "las", "y", "una", "se", "del", "con", "por", "para", "no", "su", "es", "lo"})

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


class Rule(NamedTuple):
    """``top`` over ``per`` must lie in [least, most]; it passes if ``per`` is zero."""
    name: str
    top: str
    per: str
    least: float | None
    most: float | None


#: Lengths are per one.  Every bound is inclusive.
RULES = [
    Rule("text_length", "n_words", "one", 10, None),
    Rule("word_length", "word_chars", "n_words", 2, 25),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("cut_lines", "n_cut_lines", "n_lines", None, 0.5),
]

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "n_bullet_lines", "n_cut_lines"]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``MEASURES`` of every row."""
    long = lambda c: c.cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    has_word = lambda line: F.trim(line, F.lit(BLANKS)) != ""
    # selects follow each other wherever an array is used more than once, so that it is made once a row
    a = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("t"), words(F.col(text_col).cast("string")).alias("w"))
    a = a.select("doc_id", "w", F.filter(F.split("t", "\n", -1), has_word).alias("lines"), shingle_hashes("w", WINDOW).alias("h"),
                 (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"))
    again = F.size("h") > F.size(F.array_distinct("h"))
    a = a.select("*", F.when(again, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda x, k, d: F.coalesce(F.get(F.col("s"), k + d)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, k: ((k > 0) & same(x, k, -1)) | same(x, k, 1))
    a = a.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("at"))
    # a repeated window covers its words up to the next one's begin
    cover = F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("at"), k + 1) - p, F.lit(WINDOW))))
    bullet = r"^[ \t]*([-*•]|[0-9]+[.)])[ \t]"
    cut = r"(\.\.\.|…)[\x20\x09-\x0D]*$"
    return a.select(
        "doc_id", long(F.size("w")).alias("n_words"), long(F.length(F.concat_ws("", "w"))).alias("word_chars"),
        long(F.col("n_symbols")).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.coalesce(F.aggregate(cover, F.lit(0), lambda s, x: s + x), F.lit(0))).alias("n_repeat_words"),
        long(F.size(F.filter("w", lambda w: F.lower(w).isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size(F.filter("lines", lambda x: x.rlike(bullet)))).alias("n_bullet_lines"),
        long(F.size(F.filter("lines", lambda x: x.rlike(cut)))).alias("n_cut_lines"))


def fails(rule: Rule) -> Column:
    top, per = F.col(rule.top).cast("double"), F.lit(1.0) if rule.per == "one" else F.col(rule.per).cast("double")
    out = F.lit(False)
    if rule.least is not None:
        out = out | (top < rule.least * per)
    if rule.most is not None:
        out = out | (top > rule.most * per)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, ``MEASURES``, base_failed, kept and failed (names of the broken rules, in the table's order)."""
    rules = RULES if rules is None else rules
    m = measures(docs, id_col, text_col)
    broken = reduce(lambda a, b: a | b, map(fails, rules), F.lit(False))
    names = F.concat_ws(",", *[F.when(fails(r), r.name) for r in rules]) if rules else F.lit("")
    return m.select("doc_id", *MEASURES, base_failed().alias("base_failed"), (~base_failed() & ~broken).alias("kept"), names.alias("failed"))


def _sql_fails(rule: Rule) -> str:
    per = "1" if rule.per == "one" else rule.per
    parts = [f"{rule.top} < {rule.least} * {per}"] * (rule.least is not None) + [f"{rule.top} > {rule.most} * {per}"] * (rule.most is not None)
    return "(" + " OR ".join(parts) + ")"


def oracle() -> str:
    """DuckDB SQL for the query's columns."""
    blank = r"[\x20\x09-\x0D]"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*([-*•]|[0-9]+[.)])[ \t]'))) AS n_bullet_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…){blank}*$'))) AS n_cut_lines
      FROM w LEFT JOIN n USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({' OR '.join(map(_sql_fails, RULES))}) AS kept FROM b"""
