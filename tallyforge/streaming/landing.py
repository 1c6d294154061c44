"""A landing folder as a stream: each batch is deduplicated against the ledger, so a replayed batch adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.balance import late_rows
from ..operators.ingest import keep_first, not_loaded
from ..sources.sketch import SketchedLedger
from ..sources.tables import settled

MAX_FAILURES = 2


def landed(spark: SparkSession, path: str, schema: str | StructType, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def failures(history: DataFrame, most: int = MAX_FAILURES) -> DataFrame:
    """Files that failed so often that they are not tried again."""
    return history.groupBy("file").agg(F.count_if(F.col("status") == "failed").alias("n_failed")).filter(F.col("n_failed") >= most)


def batch_counters(history: DataFrame) -> DataFrame:
    return history.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("status") == "success").alias("success"), F.count_if(F.col("status") == "failed").alias("failed"))


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each key."""
    return events.groupBy("key").agg(F.max_by("status_json", "updated_at").alias("status_json"), F.max("updated_at").alias("updated_at"))


def load_batch(batch: DataFrame, ledger_path: str, review_path: str, key: list[str], order: list[str], day: str = "txn_date") -> None:
    """Appends a batch's new rows to the ledger and rows older than an account's last day to the review table.

    The ledger is read anew in each batch, so a batch that is run twice finds its own rows.
    """
    spark = batch.sparkSession
    review = spark.read.schema(batch.schema).option("recursiveFileLookup", False).parquet(review_path) if _exists(spark, review_path) else batch.limit(0)
    ledger = spark.read.schema(batch.schema).parquet(ledger_path) if _exists(spark, ledger_path) else batch.limit(0)
    fresh = keep_first(not_loaded(not_loaded(batch, ledger, key), review, key), key, order)
    marked = late_rows(fresh, ledger, ["account_number"], day).persist()
    marked.filter("is_late").drop("is_late").write.mode("append").parquet(review_path)
    marked.filter("not is_late").drop("is_late").write.mode("append").parquet(ledger_path)
    marked.unpersist()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_landing(stream: DataFrame, ledger_path: str, review_path: str, checkpoint: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Everything that has landed, then an end: the checkpoint acknowledges what was loaded."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: load_batch(batch, ledger_path, review_path, key, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def load_part(batch: DataFrame, part: str, ledger: SketchedLedger, review: SketchedLedger, order: list[str]) -> tuple[int, int]:
    """As load_batch, but a batch is a part of the ledger and one of the review table, and is compared with the parts alone that may hold its keys.

    A batch that is run anew replaces its own two parts, at whatever point the first run
    was lost. Gives how many parts of the ledger and of the review table were read.
    """
    rows = settled(ledger.typed(batch))
    held, seen = ledger.may_hold(rows, but=part), review.may_hold(rows, but=part)
    fresh = keep_first(not_loaded(not_loaded(rows, ledger.read(held), ledger.key), review.read(seen), ledger.key), ledger.key, order)
    marked = settled(late_rows(fresh, ledger.last_days(but=part), ledger.account, ledger.day))
    review.put(marked.filter("is_late"), part)
    ledger.put(marked.filter("not is_late"), part)
    return len(held), len(seen)


def run_parts(stream: DataFrame, ledger: SketchedLedger, review: SketchedLedger, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Everything that has landed, then an end. Parts are named after the checkpoint's own id and the batch, so a new checkpoint does not write over parts of an old one."""

    def load(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the stream has no id to name its parts by")
        load_part(batch, f"{query}-{number:09d}", ledger, review, order)

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
