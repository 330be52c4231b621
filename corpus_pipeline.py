"""A corpus pipeline of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from creditlake.llm import stages
from creditlake.llm.common import cut_lineage, read

#: (name, function of (spark, docs, sf_dir)): each reads all that its predecessor kept.
STAGES = [
    ("language_id", stages.language_id),
    ("simhash_neardup", stages.simhash_neardup),
    ("decontamination", stages.decontamination),
    ("secret_scan", stages.secret_scan),
    ("packing", stages.packing),
]

#: Language identification and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
