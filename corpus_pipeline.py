"""The corpus pipeline: five stages over documents, each written as Parquet and read back by the next.

Every stage works on all that its predecessor kept, and all but the last
return the columns of documents:

1. quality classifier: documents predicted to be of low quality go;
2. SimHash near-duplicates: of each component one row stays, that with the smallest id;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: secrets are replaced in the text, and n_chars follows;
5. mixing: documents are sampled so that tokens meet the target weights.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, mixing, quality_classifier, secret_scan, simhash
from tallyforge.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on the labelled documents of the stage's own input, outside the held-out fold."""
    forest = quality_classifier.trained(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.quality_scores(docs.select(*COLUMNS), forest).filter("predicted = 1").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each component of fingerprints: that of the smallest id, of rows with that id one text, of repeated rows one.

    Rows are told apart by id and text, so an id that repeats with different texts
    is judged for each of them. Rows with a null id stand in components like others, behind all ids.
    """
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))), 256)
    rows = docs.select(*COLUMNS, key.alias("_key"))
    # Only keys travel here; texts do once, below.
    best = simhash.groups(rows, ("_key",)).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_key")).alias("b")).select("b._key")
    one = rows.join(best, "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(F.col("text").isNull().alias("n"), "doc_id", "lang", "source", "n_chars", "text")).alias("r"))
    return one.select(*(F.col(f"r.{c}").alias(c) for c in COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.secrets(docs.select(*COLUMNS))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long")).alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS, "topic", "n_tokens", F.round("probability", 6).alias("probability"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near duplicates", dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Networks, trees and XXH64 are beyond SQL; tests hold the near-duplicate stage against a brute-force version, the operators of others in tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
