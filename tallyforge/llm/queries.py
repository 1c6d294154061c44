"""The registered queries of the training-data operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, mixing, pivot_index, prefix_trie, quality_classifier, quality_rules, secret_scan, simhash, spelling, suffix_dedup, token_counts, warc_fixity
from .common import table

RECORDS_PER_FILE = 256


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), redact=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores", "n_model")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_template_words")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mixed(docs, columns=["doc_id", "source", "lang"]).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality_classifier.trained(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.quality_scores(docs, forest).select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records, 256 ids a file; the second replica has the damage of a failing disk: a changed byte or a cut tail."""
    record = warc_fixity.warc_record(F.col("url"), F.col("html"))
    draw = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    damaged = F.when(draw == "0a", F.concat(F.lit("X"), F.substring(record, 2, 2**31 - 1))).when(draw == "0b", F.substring(record, 1, 40)).otherwise(record)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = lambda bytes_of: pages.select(
        F.coalesce(F.floor(F.col("page_id") / RECORDS_PER_FILE), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1_000_003))).alias("file"),
        F.coalesce(F.pmod("page_id", F.lit(RECORDS_PER_FILE)), F.lit(0)).alias("seq"), F.col("page_id").alias("record_id"), bytes_of.alias("record"),
    )
    return warc_fixity.audit_replicas(replica(record), replica(damaged), levels=2)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_html_extraction, op3_mixing, op4_suffix_dedup, op5_decontamination, op6_quality_rules, op7_quality_classifier, op8_token_counts, op9_warc_fixity, op10_simhash, op11_spelling, op12_topk, op13_prefix_trie)}
