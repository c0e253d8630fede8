"""Registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import decontaminate, divergence, exact_dedup, filter_audit, html_text, jaccard, line_dedup, pieces, pii, quality, secrets, sharding, toxicity
from locusframe.llm.common import read


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document, by the cuckoo index of live digests."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the trees learn from rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the model learns from rows that are not held out."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, exact of every document."""
    return pieces.encode_documents(read(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document against all benchmark items."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and hash of the base findings, and all spans of every document."""
    return secrets.find_secrets(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_line_dedup": line_dedup.query,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard": jaccard.query,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": pii.query,
    "op9_sharding": sharding.query,
    "op10_secrets": op10_secrets,
    "op11_html_text": html_text.query,
    "op12_filter_audit": filter_audit.query,
    "op13_divergence": divergence.query,
}
ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
