"""State kept within a stream: how often a file failed, and the latest status of each key.

What is kept of a key are counts and greatest values, so a key with any number of rows
holds one small state, and the order of rows does not matter: a batch that is run anew
gives the same. Where nothing ends the state this is a streaming aggregation, which adds rows up in
tasks before they are shuffled; a timer needs a processor of its own. State lies in RocksDB, in the
checkpoint folder of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .landing import MAX_FAILURES

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GUARD = "file string, n_tried long, n_failed long, last_at timestamp, is_skipped boolean, is_ended boolean"
STATUS = "key string, status_json string, updated_at timestamp"


def _us(at: pd.Timestamp) -> int:
    return int(at.value // 1000)  # value is in nanoseconds, whatever the unit of at


class _Guard(StatefulProcessor):
    """Attempts and failures of a file; a timer ends them keep_ms after the last attempt."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n_tried long, n_failed long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tried, failed, last = self.seen.get() if self.seen.exists() else (0, 0, None)
        before = last
        for part in rows:
            tried += len(part)
            failed += int((part["status"] == "failed").sum())
            at = part["at"].dropna()
            if len(at):
                newest = _us(at.max())
                last = newest if last is None else max(last, newest)
        self.seen.update((tried, failed, last))
        if last is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(before // 1000 + self.keep_ms)
            self.handle.registerTimer(last // 1000 + self.keep_ms)
        yield self._row(key, tried, failed, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tried, failed, last = self.seen.get()
        self.seen.clear()
        yield self._row(key, tried, failed, last, True)

    def _row(self, key, tried, failed, last, ended) -> pd.DataFrame:
        at = pd.NaT if last is None else pd.Timestamp(last, unit="us")
        return pd.DataFrame({"file": [key[0]], "n_tried": [tried], "n_failed": [failed], "last_at": pd.Series([at], dtype="datetime64[us]"), "is_skipped": [failed >= self.most and not ended], "is_ended": [ended]})

    def close(self) -> None:
        pass


def guarded(attempts: DataFrame, most: int = MAX_FAILURES, keep_ms: int | None = None) -> DataFrame:
    """A stream of attempts (file, status, at) -> of each file in a batch its state so far: is_skipped from the most-th failure on.

    Without keep_ms state is kept for ever, and no row is left out. With it the stream needs
    a watermark on at: once that has passed the last attempt by keep_ms, the file's state
    ends with a row of is_ended, and the file counts from nothing; rows older than the
    watermark are then left out by Spark. Rows without a status count as tried, rows without
    a time for the counts alone.
    """
    if keep_ms is None:
        failed = F.count_if(F.col("status") == "failed")
        return attempts.groupBy("file").agg(
            F.count(F.lit(1)).alias("n_tried"), failed.alias("n_failed"), F.max("at").alias("last_at"), (failed >= most).alias("is_skipped"), F.lit(False).alias("is_ended"),
        )
    return attempts.select("file", "status", "at").groupBy("file").transformWithStateInPandas(_Guard(most, keep_ms), GUARD, "Update", "EventTime")


def latest_statuses(events: DataFrame) -> DataFrame:
    """A stream of (key, status_json, updated_at) -> the last status by time of each key that a batch changes; of equal times the largest text. Rows without a time or a status change nothing."""
    # The time of the batch, which Spark logs with its offsets: a status that first came before the key's last batch was there already.
    told = events.filter("updated_at is not null and status_json is not null").withColumn("_at", F.unix_millis(F.current_timestamp()))
    last = told.groupBy("key").agg(F.max(F.struct("updated_at", "status_json", (-F.col("_at")).alias("first"))).alias("_l"), F.max("_at").alias("_seen"))
    return last.filter(F.col("_l.first") == -F.col("_seen")).select("key", "_l.status_json", "_l.updated_at")


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def run_updates(states: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """All that has landed, then an end. Each batch's states go to a folder of its own, which a batch that is run anew writes anew."""
    with _state_in_rocksdb(states.sparkSession):
        return (
            states.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{out}/batch={batch}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def newest(spark: SparkSession, out: str, key: str) -> DataFrame:
    """The last state of each key over all batches."""
    u = spark.read.parquet(out)
    columns = [c for c in u.columns if c not in (key, "batch")]
    return u.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_s")).select(key, *(F.col(f"_s.{c}").alias(c) for c in columns))
