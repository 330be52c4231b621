"""Queries opN_<name>: each operator over its whole table, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm import (
    ctph,
    decontamination,
    fim_frames,
    language_id,
    packing,
    paragraph_dedup,
    prefix_trie,
    quality_cnn,
    quality_rules,
    secret_scan,
    simhash_vp,
    toxicity,
    warc,
)
from creditlake.llm.common import crc_bucket, read, vocabulary


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in packed sequences of at most 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op2_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    got = simhash_vp.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = read(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 3) == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = read(spark, sf_dir, "documents")
    learn = language_id.learnable()
    return language_id.identify(docs, language_id.fit(docs, learn)).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and passage that repeats in another document."""
    return paragraph_dedup.repeated(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and verdict."""
    return quality_rules.judge(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    got = secret_scan.secrets(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = read(spark, sf_dir, "documents")
    held = crc_bucket("doc_id", 4) == 2
    net = quality_cnn.fit(docs, read(spark, sf_dir, "labels"), ~held)
    return quality_cnn.score(docs, net).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best match with each benchmark item that it holds."""
    got = decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    return warc.archived(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, held against its edited text's and the next document's."""
    return ctph.against_next(read(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-middle form, as digests of the output and of the text rebuilt from it."""
    return fim_frames.digests(fim_frames.fill_in_middle(read(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"))


OP10_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= {warc.MIN_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to FROM p LEFT JOIN m USING (payload_digest)"""


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_packing, op2_simhash_neardup, op3_toxicity, op4_language_id, op5_paragraph_dedup, op6_quality_rules, op7_secret_scan, op8_quality_cnn,
        op9_decontamination, op10_warc, op11_piecewise_fingerprints, op12_fill_in_middle,
        op13_prefix_trie)}


def oracle_sql() -> dict:
    return {"op6_quality_rules": quality_rules.oracle(), "op9_decontamination": decontamination.oracle(), "op10_warc": OP10_SQL,
            "op12_fill_in_middle": fim_frames.oracle(), "op13_prefix_trie": prefix_trie.oracle()}
