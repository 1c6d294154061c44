"""Running balances, their check against what the bank reports, and the direction of a statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TOLERANCE = 0.01


def direction(df: DataFrame, key: list[str], day: str = "txn_date", default: str = "desc") -> DataFrame:
    """asc or desc per key by its first and last rows in physical order; a tie takes the default."""
    ends = df.groupBy(*key).agg(F.min_by(day, "row_pos").alias("first_day"), F.max_by(day, "row_pos").alias("last_day"))
    return ends.withColumn("direction", F.when(F.col("first_day") < F.col("last_day"), "asc").when(F.col("first_day") > F.col("last_day"), "desc").otherwise(default))


def _running(amount: Column, seed: Column, w: WindowSpec) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.first(seed).over(frame) + F.sum(amount).over(frame)


def running_balance(df: DataFrame, key: list[str], order: list[str], name: str = "balance", block: Column | None = None) -> DataFrame:
    """The first row in the order seeds the chain with its reported balance; each later one adds credits and takes debits.

    block: what cuts an account's rows into runs that follow each other in the order, such as months. With it, sums
    of blocks are scanned and then the rows of each block, so that no account goes through one task as a whole.
    """
    change = F.coalesce("credits", F.lit(0)) - F.coalesce("debits", F.lit(0))
    if block is None:
        return df.withColumn(name, _running(change, F.col("reported_balance") - change, Window.partitionBy(*key).orderBy(*order)))
    x = df.withColumn("_block", block)
    first = F.min_by(F.col("reported_balance") - change, F.struct(*order)).alias("_first")
    sums = x.groupBy(*key, "_block").agg(F.sum(change).alias("_sum"), first, F.min(F.struct(*order)).alias("_at"))
    before, whole = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.select(*(F.col(k).alias(f"_k_{k}") for k in (*key, "_block")), (F.first("_first").over(whole) + F.coalesce(F.sum("_sum").over(before), F.lit(0))).alias("_start"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*key, "_block")]
    within = Window.partitionBy(*key, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.join(starts, on).withColumn(name, F.col("_start") + F.sum(change).over(within)).select(*df.columns, name)


def balance_check(df: DataFrame, balance: str = "balance") -> DataFrame:
    """check: reported less running, to the cent; is_error where it is not zero."""
    check = F.round(F.col("reported_balance") - F.col(balance), 2)
    return df.withColumn("check", check).withColumn("is_error", F.abs("check") >= TOLERANCE)


def serial_numbers(df: DataFrame, key: list[str], order: list, start: Column | int = 0) -> DataFrame:
    start = F.lit(start) if isinstance(start, int) else start
    return df.withColumn("sl", start + F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def late_rows(new: DataFrame, ledger: DataFrame, key: list[str], day: str = "txn_date") -> DataFrame:
    """is_late: older than the ledger's last day for the key; such rows go to review, not to the end of the ledger."""
    last = ledger.groupBy(*key).agg(F.max(day).alias("_last"))
    return new.join(last, key, "left").withColumn("is_late", F.coalesce(F.col(day) < F.col("_last"), F.lit(False))).drop("_last")
