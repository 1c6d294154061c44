"""From raw statement rows to new ledger rows: validation, normal forms, anti join with what is loaded, keep-first dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import MONEY, parsed_amount
from ..functions.dates import parsed_date
from ..functions.text import clean
from ..schemas import DEDUP_KEY

BROUGHT_FORWARD = "B/F"


def aligned(df: DataFrame, columns: list[str], fill: str | None = None) -> DataFrame:
    """The columns in this order; missing ones are added with fill (null unless given), others dropped."""
    have = set(df.columns)
    return df.select(*(F.col(c) if c in have else F.lit(fill).cast("string").alias(c) for c in columns))


def union_aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union in the first table's columns; what the first lacks is dropped, what others lack is empty text."""
    out = first
    for x in others:
        out = out.unionByName(aligned(x, first.columns, ""))
    return out


def validated(rows: DataFrame) -> DataFrame:
    """Rows with both a transaction date and a description."""
    return rows.filter((F.trim("txn_date") != "") & (F.trim("description") != ""))


def without_empty_rows(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows in which any of the columns (all, if none are named) has something in it."""
    filled = F.lit(False)
    for c in columns or rows.columns:
        filled = filled | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return rows.filter(filled)


def whole_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text that is a number as that number is shown, whole values without decimals; other text stays."""

    def shown(c: str) -> Column:
        n = F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("decimal(30,6)")
        text = F.regexp_replace(F.regexp_replace(n.cast("string"), r"0+$", ""), r"\.$", "")
        return F.when(n.isNotNull(), text).otherwise(F.col(c))

    return df.withColumns({c: shown(c) for c in columns})


def without_brought_forward(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.upper(F.trim("description")), F.lit("")) != BROUGHT_FORWARD)


def normalized(rows: DataFrame) -> DataFrame:
    """Typed columns: dates, decimals, trimmed text."""
    return rows.select(
        *(c for c in ("source", "company", "account_number", "row_pos") if c in rows.columns),
        parsed_date(F.col("txn_date")).alias("txn_date"),
        parsed_date(F.col("value_date")).alias("value_date"),
        clean(F.col("description")).alias("description"),
        clean(F.col("reference")).alias("reference"),
        parsed_amount(F.col("debits")).alias("debits"),
        parsed_amount(F.col("credits")).alias("credits"),
        F.replace(F.trim("balance"), F.lit(","), F.lit("")).try_cast(MONEY).alias("reported_balance"),
    )


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Nulls in a key are equal to each other.

    min over the order columns and a whole-row struct: partial aggregation
    before the shuffle, so repeats of one key never meet in full.
    """
    rest = [c for c in rows.columns if c not in order]
    first = F.min(F.struct(*order, *(c for c in rest if c not in key))).alias("_first")
    return rows.groupBy(*key).agg(first).select(*(F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def not_loaded(new: DataFrame, existing: DataFrame, key: list[str] | tuple[str, ...] = DEDUP_KEY) -> DataFrame:
    """Left anti join on the key, null-safe."""
    old = existing.select(*(F.col(c).alias(f"_e_{c}") for c in key)).distinct()
    condition = F.lit(True)
    for c in key:
        condition = condition & new[c].eqNullSafe(old[f"_e_{c}"])
    return new.join(old, condition, "left_anti")


def ingest(raw: DataFrame, existing: DataFrame, key: tuple[str, ...] = DEDUP_KEY) -> DataFrame:
    """New ledger rows of a batch: a second run with the result loaded gives none."""
    account = [c for c in ("company", "account_number") if c in raw.columns and c in existing.columns]
    rows = normalized(without_brought_forward(validated(raw)))
    return keep_first(not_loaded(rows, existing, [*account, *key]), [*account, *key], ["row_pos"])


def ingest_metrics(raw: DataFrame, new: DataFrame) -> DataFrame:
    """total, new, brought_forward and skipped (total less new, brought-forward rows included)."""
    r = raw.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.upper(F.trim("description")) == BROUGHT_FORWARD).alias("brought_forward"))
    n = new.agg(F.count(F.lit(1)).alias("new"))
    # One row each.
    return r.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select("total", "new", "brought_forward", (F.col("total") - F.col("new")).alias("skipped"))


def fill_blanks(df: DataFrame, values: dict) -> DataFrame:
    """Computed values where a column is blank; others are never overwritten."""
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(c), F.lit("")), v) for c, v in values.items()})


def replaced_labels(df: DataFrame, column: str, renames: dict[str, str]) -> DataFrame:
    return df.replace(renames, subset=[column])


def changed_rows(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Rows in which any new value differs, null-safe."""
    differs = F.lit(False)
    for a, b in zip(old, new, strict=True):
        differs = differs | ~F.col(a).eqNullSafe(F.col(b))
    return df.filter(differs)


def enum_or_default(df: DataFrame, column: str, allowed: list[str], default: str) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).isin(allowed), F.col(column)).otherwise(F.lit(default)))


def extra_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values in use that the allowed list lacks: they are kept, and listed."""
    return df.select(column).distinct().filter(F.col(column).isNotNull() & ~F.col(column).isin(allowed))


def searched(df: DataFrame, columns: list[str], term: str, **equal: str) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(term.lower())
    out = df.filter(hit) if term else df
    for c, v in equal.items():
        out = out.filter(F.col(c) == v)
    return out


def within_year(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """One row: whether all dates lie in the year, and their range."""
    return df.agg(F.min(column).alias("first_day"), F.max(column).alias("last_day")).withColumn("inside", (F.col("first_day") >= F.lit(first).cast("date")) & (F.col("last_day") <= F.lit(last).cast("date")))


def recent(df: DataFrame, order: list, n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)


def keep_newest(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def latest_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order of each key, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    last = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_last")
    return df.groupBy(*key).agg(last).select(*(F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in df.columns))


def single_active(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """is_active: true for the latest row of each key alone."""
    last = df.groupBy(*key).agg(F.max(order).alias("_last"))
    return df.join(last, key).withColumn("is_active", F.col(order) == F.col("_last")).drop("_last")
