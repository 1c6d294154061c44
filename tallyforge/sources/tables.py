"""Tables as the engine reads and writes them: partitioned by company and account, never one table an account."""

from __future__ import annotations

from collections.abc import Callable
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.amounts import parsed_amount
from ..functions.dates import parsed_date
from ..schemas import DEDUP_KEY

RESERVED = ["Beneficiary Master", "Manual Overrides", "Rules", "Summary"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The table worked out once: a reliable checkpoint in the folder that the session names, else kept on the executors (tests, single machines)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            return df.persist()
        sc.setCheckpointDir(named)
    return df.checkpoint()


def as_strings(df: DataFrame) -> DataFrame:
    """A full scan with every column as text, missing cells empty."""
    return df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns))


def typed_ledger(df: DataFrame, amounts: tuple[str, ...] = ("debits", "credits"), texts: tuple[str, ...] = ("description",)) -> DataFrame:
    """Text upper and trimmed, amounts as decimals with 0 for bad ones. Errors of reading are raised, not turned into an empty table."""
    return df.withColumns({**{c: F.upper(F.trim(c)) for c in texts}, **{c: parsed_amount(F.col(c).cast("string")) for c in amounts}})


def data_tables(catalog: DataFrame, name: str = "name", reserved: list[str] | None = None) -> DataFrame:
    return catalog.filter(~F.col(name).isin(RESERVED if reserved is None else reserved))


def dated_rows(rows: DataFrame, day: str = "txn_date") -> DataFrame:
    """Rows whose date can be read: headers, markers and blank spacers go."""
    return rows.filter(parsed_date(F.col(day).cast("string")).isNotNull())


def snapshot(rows: DataFrame, key: list[str]) -> DataFrame:
    """First and last position and number of data rows per table, in one pass."""
    return rows.groupBy(*key).agg(F.min("row_pos").alias("first_pos"), F.max("row_pos").alias("last_pos"), F.count(F.lit(1)).alias("n_rows"))


def below_header(grid: DataFrame, named: str, key: list[str]) -> DataFrame:
    """Rows (cells: array) below the first row that has a cell of this name."""
    head = grid.filter(F.array_contains(F.transform("cells", lambda c: F.upper(F.trim(c))), named.upper())).groupBy(*key).agg(F.min("row_pos").alias("_head"))
    return grid.join(head, key).filter(F.col("row_pos") > F.col("_head")).drop("_head")


def config_map(c: Column) -> Column:
    """A JSON map without its comments: keys that begin with an underscore."""
    return F.map_filter(F.from_json(c, "map<string,string>"), lambda k, _: ~k.startswith("_"))


def json_config(spark: SparkSession, path: str, schema: str, one_a_file: bool = True) -> DataFrame:
    """Configurations as JSON: one a file, over as many lines as it likes, or one a line. A folder that does not exist is an error, not an empty configuration."""
    return spark.read.schema(schema).option("multiLine", one_a_file).json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("company", "account_number").parquet(path)


def merged_update(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Cell updates: new values where there are any, old ones elsewhere; rows without an update are kept."""
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    return old.join(n, key, "left").select(*(F.coalesce(F.nullif(F.col(f"_{c}").cast("string"), F.lit("")).cast(old.schema[c].dataType), c).alias(c) if c in columns else F.col(c) for c in old.columns))


def overwrite_partitions(rows: DataFrame, path: str) -> None:
    """Replaces only the partitions that rows hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("company", "account_number").parquet(path)


def extended(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing columns added at the end with their types; none moved."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns))


def inserted_column(df: DataFrame, after: str, name: str, copied_from: str) -> DataFrame:
    """A column in the middle with another's values; a table that has it stays as it is."""
    if name in df.columns:
        return df
    at = df.columns.index(after) + 1
    return df.select(*df.columns[:at], F.col(copied_from).alias(name), *df.columns[at:])


def row_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def renamed_tables(catalog: DataFrame, renames: dict[str, str], name: str = "name") -> DataFrame:
    """What a rename would do: old and new name, nothing written."""
    return catalog.filter(F.col(name).isin(list(renames))).select(F.col(name).alias("old_name")).withColumn("new_name", F.create_map(*(F.lit(x) for kv in renames.items() for x in kv))[F.col("old_name")])


def duplicates_on_file(rows: DataFrame, key: tuple[str, ...] = DEDUP_KEY) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def capped_log(log: DataFrame, order: list, keep: int = 500) -> DataFrame:
    """The newest entries: a top-k, which tasks cut before they send."""
    return log.orderBy(*order).limit(keep)


def newest_files(files: DataFrame, keep: int) -> DataFrame:
    """Files to delete: all of each folder but the newest."""
    return files.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("modified"), "name"))).filter(F.col("_n") > keep).drop("_n")


def with_retry(call: Callable, is_transient: Callable[[Exception], bool], attempts: int = 4, first_wait: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """Calls again after 2, 4 and 8 seconds while the error is one that passes; other errors are raised at once."""
    for k in range(attempts):
        try:
            return call()
        except Exception as e:
            if k == attempts - 1 or not is_transient(e):
                raise
            sleep(first_wait * 2**k)


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A store's table; filters and columns reach the database."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def dropped(df: DataFrame, column: str) -> DataFrame:
    """Without a column, if the table has it."""
    return df.drop(column)


def with_links(accounts: DataFrame, links: DataFrame, tabs: DataFrame, key: str = "account_number") -> DataFrame:
    """Accounts with their link and the name of their tab: null where there is none; of several links the one added last."""
    last = links.groupBy(key).agg(F.max_by("link", "added").alias("link"))
    named = tabs.groupBy(key).agg(F.min("tab").alias("tab"))
    return accounts.join(last, key, "left").join(named, key, "left")


def edited(df: DataFrame, edits: DataFrame, key: str = "row_no") -> DataFrame:
    """A table after edits (action, key, and its other columns): update replaces the row, delete takes it out, append adds one behind the last. Of several edits of a row the last by edit_no holds; row numbers are then counted anew."""
    rest = [c for c in df.columns if c != key]
    last = edits.filter("action <> 'append'").groupBy(key).agg(F.max_by(F.struct("action", *rest), "edit_no").alias("_e"))
    kept = df.join(last, key, "left").filter(~F.coalesce(F.col("_e.action") == "delete", F.lit(False)))
    changed = kept.select(F.lit(0).alias("_t"), F.col(key).cast("long").alias("_o"), *(F.when(F.col("_e.action") == "update", F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) for c in rest))
    added = edits.filter("action = 'append'").select(F.lit(1).alias("_t"), F.col("edit_no").cast("long").alias("_o"), *rest)
    from .stored import numbered

    return numbered(changed.unionByName(added), [F.col("_t"), F.col("_o")], key).select(*df.columns)


def log_state(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """What a store that is only appended to says now: the newest value that is not null of each column (upsert, update-latest), and no rows whose last entry is a delete."""
    rest = [c for c in log.columns if c not in (key, order, "op")]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    return log.groupBy(key).agg(F.max_by("op", order).alias("_op"), *newest).filter("_op <> 'delete'").drop("_op")
