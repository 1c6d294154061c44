"""Rows put between others of a stored ledger: each row has a label that orders it, and a new row takes one between its neighbours'.

Labels are whole numbers with wide gaps. Rows placed between two others share the gap evenly, so nothing that is stored changes;
where a gap has too few numbers left, the labels of that account are spread anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import numbered
from ..sources.tables import settled

#: Between neighbours at first; a label is a decimal of 38 digits.
GAP = 1 << 40
LABEL = "decimal(38,0)"


def labelled(rows: DataFrame, order: list, account: str = "account_number") -> DataFrame:
    """rows with label, in this order within each account."""
    x = numbered(rows, order, "_n", [account])
    return x.withColumn("label", (F.col("_n").cast(LABEL) * F.lit(GAP)).cast(LABEL)).drop("_n")


def inserted(stored: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, moved): plan's rows with their labels, and stored rows whose labels had to change, with the new ones.

    stored: account_number, row_pos, label. plan, as reconcile.placed gives it: account_number, row_pos, block, seq, upper_row, lower_row.
    A block goes right above its lower_row; without one, right below its upper_row; without either, above all of its account. Blocks of one place
    follow each other by block, then seq. row_pos tells the stored rows of an account apart, and the new ones; rows of plan whose neighbour is not
    stored go above all. Null accounts are one account.
    """
    key = F.coalesce("account_number", F.lit(""))
    s = settled(stored.select("account_number", F.col("row_pos").alias("at_row"), "label").withColumn("_a", key))
    # Each stored row knows the label above it. That needs the order of an account: in ranges, as labels are.
    order = settled(numbered(s, [F.col("label")], "_n", ["_a"]))
    above = order.select("_a", (F.col("_n") + 1).alias("_n"), F.col("label").alias("above"))
    below = order.select("_a", (F.col("_n") - 1).alias("_n"), F.col("label").alias("below"))
    gaps = settled(order.join(above, ["_a", "_n"], "left").join(below, ["_a", "_n"], "left").select("_a", "at_row", "label", F.coalesce("above", F.col("label") - GAP).alias("above"), F.coalesce("below", F.col("label") + GAP).alias("below"), "_n"))
    p = plan.select("account_number", "row_pos", "block", "seq", "upper_row", "lower_row").withColumn("_a", key)
    low = gaps.select("_a", F.col("at_row").alias("lower_row"), F.col("above").alias("_l0"), F.col("label").alias("_l1"))
    up = gaps.select("_a", F.col("at_row").alias("upper_row"), F.col("label").alias("_u0"), F.col("below").alias("_u1"))
    top = gaps.filter("_n = 1").select("_a", F.col("above").alias("_t0"), F.col("label").alias("_t1"))
    x = p.join(low, ["_a", "lower_row"], "left").join(up, ["_a", "upper_row"], "left").join(top, "_a", "left")
    lo = F.coalesce("_l0", "_u0", "_t0", F.lit(0)).cast(LABEL)
    hi = F.coalesce("_l1", "_u1", "_t1", F.lit(GAP)).cast(LABEL)
    x = settled(x.select("account_number", "_a", "row_pos", "block", "seq", lo.alias("lo"), hi.alias("hi")))
    ranked = numbered(x, [F.col("block"), F.col("seq"), F.col("row_pos")], "_k", ["_a", "lo"])
    many = x.groupBy("_a", "lo").agg(F.count(F.lit(1)).alias("_of"), F.min("hi").alias("_hi"))
    y = settled(ranked.join(many, ["_a", "lo"]).withColumn("full", F.col("_hi") - F.col("lo") <= F.col("_of")))
    step = F.floor((F.col("_hi") - F.col("lo")) / (F.col("_of") + 1)).cast(LABEL)
    tight = settled(y.filter("full").select("_a").distinct())
    added = y.join(tight, "_a", "left_anti").select("account_number", "row_pos", (F.col("lo") + F.col("_k") * step).cast(LABEL).alias("label"))
    # Accounts that have run out: stored and new rows in one order, labels spread anew.
    old = s.join(tight, "_a", "left_semi").select("account_number", "_a", F.col("at_row").alias("row_pos"), F.col("label").alias("lo"), F.lit(0).cast("long").alias("_k"), F.lit(False).alias("is_new"))
    new = y.join(tight, "_a", "left_semi").select("account_number", "_a", "row_pos", "lo", F.col("_k").cast("long").alias("_k"), F.lit(True).alias("is_new"))
    spread = settled(numbered(old.unionByName(new), [F.col("lo"), F.col("_k")], "_n", ["_a"]).withColumn("label", (F.col("_n").cast(LABEL) * F.lit(GAP)).cast(LABEL)))
    columns = ("account_number", "row_pos", "label")
    return added.unionByName(spread.filter("is_new").select(*columns)), spread.filter("not is_new").select(*columns)
