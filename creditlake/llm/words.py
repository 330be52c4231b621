"""Words and word shingles as Spark expressions (no user functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditlake.llm.common import WORD_SPLIT

#: The ASCII blanks that part words.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The text's words; none for null. Select it into a column before using it more than once."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_SPLIT))


def shingle_hashes(word_col: str, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order; empty if there are fewer words."""
    w = F.col(word_col)
    n = F.size(w) - width + 1
    run = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
    return F.when(n > 0, run).otherwise(F.array().cast("array<bigint>"))
