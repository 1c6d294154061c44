"""A stored table that can be edited: versions of a manifest over files that are never changed.

Rows lie in buckets by a hash of their key. A version's manifest names the folders of each bucket; an edit reads the
buckets that hold the keys of its rows, writes those anew, and puts a new manifest beside the old one. The manifest's
name is its version, and a file of that name can be made once only: of two writers that began from the same version the second
is refused and has to look again. Readers of an older version keep what they see.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import settled

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has put a version in place since this one looked."""


@dataclass(frozen=True)
class Version:
    """number, and the folders of each bucket that holds rows, below the table's own folder."""

    number: int
    folders: dict[str, list[str]]


class StoredTable:
    """Rows with a key under path. A key is one row, except in a table of entries, where several rows may share one (append, update_latest)."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType | str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # -- versions -------------------------------------------------------------------------------------------------

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs("_versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one asked for; version 0 is the empty table."""
        number = max(self.versions(), default=0) if number is None else number
        if number == 0:
            return Version(0, {})
        text = self.spark.read.option("wholetext", True).text(f"{self.path}/_versions/{number}.json").first()[0]
        return Version(number, json.loads(text))

    def _commit(self, base: Version, folders: dict[str, list[str]]) -> Version:
        p, fs = self._fs(f"_versions/{base.number + 1}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(f"version {base.number + 1} of {self.path} is there already") from e
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        return Version(base.number + 1, folders)

    # -- reading --------------------------------------------------------------------------------------------------

    def _read(self, version: Version, buckets: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/{f}" for b, fs in version.folders.items() if buckets is None or b in buckets for f in fs]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.version(version))

    # -- writing --------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _put(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows in a folder a bucket and returns the folders."""
        name = f"data/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema), self._bucket().alias("_b")).repartition("_b").write.partitionBy("_b").parquet(f"{self.path}/{name}")
        p, fs = self._fs(name)
        return {s.getPath().getName().removeprefix("_b="): f"{name}/{s.getPath().getName()}" for s in fs.listStatus(p) if s.isDirectory()}

    def _touched(self, changes: DataFrame) -> list[str]:
        # At most as many rows as there are buckets.
        return [str(r[0]) for r in changes.select(self._bucket().alias("b")).distinct().collect()]

    def _rewritten(self, base: Version, buckets: list[str], rows: DataFrame) -> Version:
        put = self._put(rows)
        kept = {b: f for b, f in base.folders.items() if b not in buckets}
        return self._commit(base, kept | {b: [f] for b, f in put.items()})

    def append(self, rows: DataFrame, base: Version | None = None) -> Version:
        """Adds rows; no file is read or rewritten."""
        base = base or self.version()
        put = self._put(rows)
        return self._commit(base, {b: base.folders.get(b, []) + ([put[b]] if b in put else []) for b in {**base.folders, **put}})

    def _one(self, changes: DataFrame, order: str | None) -> DataFrame:
        """One row a key: the last by order, by the rest of the row where that ties."""
        rest = [c for c in changes.columns if c not in self.key]
        best = F.max(F.struct(*([order] if order else []), *(c for c in rest if c != order)))
        return settled(changes.groupBy(*self.key).agg(best.alias("_c")).select(*self.key, *(F.col(f"_c.{c}").alias(c) for c in rest)))

    def _beside(self, old: DataFrame, new: DataFrame, how: str) -> DataFrame:
        n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns), F.lit(True).alias("_new"))
        same = F.lit(True)
        for k in self.key:
            same = same & old[k].eqNullSafe(n[f"_n_{k}"])
        return old.withColumn("_old", F.lit(True)).join(n, same, how)

    def upsert(self, rows: DataFrame, order: str | None = None, base: Version | None = None) -> Version:
        """Rows take the place of those of their keys, or are added. Columns that rows lack keep what the table has; of repeated keys the last by order holds."""
        base, new = base or self.version(), self._one(rows, order)
        buckets = self._touched(new)
        x = self._beside(self._read(base, buckets), new, "full")
        value = lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in rows.columns else F.col(c)
        return self._rewritten(base, buckets, x.select(*(value(f.name).alias(f.name) for f in self.schema)))

    def update_latest(self, changes: DataFrame, newest: list[str], order: str | None = None, base: Version | None = None) -> Version:
        """Of each key's rows the newest (the largest by the columns newest) takes the values of changes that are not null; keys that the table lacks change nothing."""
        base, new = base or self.version(), self._one(changes, order)
        buckets = self._touched(new)
        old = settled(self._read(base, buckets).withColumn("_row", F.monotonically_increasing_id()))
        last = old.groupBy(*self.key).agg(F.max(F.struct(*newest, "_row")).alias("_m")).select(F.col("_m._row").alias("_row"), F.lit(True).alias("_last"))
        x = self._beside(old.join(last, "_row", "left"), new, "left")
        hit = F.coalesce(F.col("_last") & F.col("_new"), F.lit(False))
        value = lambda c: F.when(hit, F.coalesce(F.col(f"_n_{c}"), F.col(c))).otherwise(F.col(c)) if c in changes.columns and c not in self.key else F.col(c)
        return self._rewritten(base, buckets, x.select(*(value(f.name).alias(f.name) for f in self.schema)))

    def delete(self, keys: DataFrame, base: Version | None = None) -> Version:
        """Takes out all rows of these keys."""
        base, gone = base or self.version(), settled(keys.select(*self.key).distinct())
        buckets = self._touched(gone)
        return self._rewritten(base, buckets, self._beside(self._read(base, buckets), gone, "left_anti"))

    def replace(self, rows: DataFrame, base: Version | None = None) -> Version:
        """The whole table anew, such as after edits by row number."""
        base = base or self.version()
        return self._commit(base, {b: [f] for b, f in self._put(rows).items()})


def numbered(rows: DataFrame, order: list[Column], name: str = "n", within: list[str] | None = None) -> DataFrame:
    """rows with their number from 1 in this order, by itself or within each key: sorted by ranges, numbered within them, and moved on by what the ranges before hold.

    No key goes through one task, and ties are numbered in any order. A table of ranges is added up, one row a range and key that lies in several.
    """
    keys = within or []
    x = settled(rows.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_part", F.spark_partition_id()))
    held = x.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_held"))
    before = held.withColumn("_before", F.sum("_held").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_part")) - F.col("_held")).drop("_held")
    on = x["_part"] == before["_part"]
    for k in keys:
        on = on & x[k].eqNullSafe(before[k])
    local = F.row_number().over(Window.partitionBy(x["_part"], *(x[k] for k in keys)).orderBy(*order))
    return x.join(F.broadcast(before) if not keys else before, on).select(*(x[c] for c in rows.columns), (F.col("_before") + local).alias(name))
