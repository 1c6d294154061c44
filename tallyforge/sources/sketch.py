"""A ledger in parts, each with a sketch of its keys beside it, so that new rows are compared with the parts alone that may hold them.

A sketch is a Bloom filter whose bits of one key all lie in one word of 64 bits, kept as a
table of (word, bits) with words that are not empty. Whether a part may hold a key is then
one equality join and one mask: no filter passes through the driver, and a full sketch is
merely less selective, never wrong. A part that has no sketch, as after a writer that was
lost between the two, is always read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import keep_first, not_loaded

#: 2^20 words hold four million keys of a part at some half a percent of false hits.
WORD_BITS, KEY_BITS = 20, 4


def _hash(key: list[str]) -> Column:
    # Null and empty keep apart, as in the exact comparison that follows.
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for k in key))


def marks(rows: DataFrame, key: list[str], word_bits: int = WORD_BITS) -> DataFrame:
    """(word, mask) of each key; repeated keys once."""
    h = _hash(key)
    mask = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        bit = F.shiftrightunsigned("h", 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return rows.select(h.alias("h")).select(F.shiftrightunsigned("h", 64 - word_bits).alias("word"), mask.alias("mask")).distinct()


class SketchedLedger:
    """Parts below root/rows, their sketches below root/sketches, and the last day of each account in a part below root/last.

    A part is written once under a name; writing it anew, as a replayed batch does, replaces it.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], schema: str, word_bits: int = WORD_BITS, account: tuple[str, ...] = ("account_number",), day: str = "txn_date"):
        self.spark, self.root, self.key, self.word_bits, self.account, self.day = spark, root, key, word_bits, list(account), day
        self.schema = spark.createDataFrame([], schema).schema

    def _below(self, kind: str) -> set[str]:
        """Names of parts that are written whole."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return set()
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return {s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if "=" in s.getPath().getName() and done(s)}

    def parts(self) -> set[str]:
        return self._below("rows")

    def read(self, parts: set[str] | None = None) -> DataFrame:
        """The ledger, or these parts of it."""
        parts = self.parts() if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/rows/part={p}" for p in sorted(parts)))

    def put(self, rows: DataFrame, part: str) -> None:
        """Writes a part and then its sketch. The old sketch goes first, so that at no time does a sketch stand beside rows that it does not know."""
        sketch = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/sketches/part={part}")
        sketch.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(sketch, True)
        last = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/last/part={part}")
        last.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(last, True)
        self.typed(rows).write.mode("overwrite").parquet(f"{self.root}/rows/part={part}")
        words = marks(self.read({part}), self.key, self.word_bits).groupBy("word").agg(F.bit_or("mask").alias("bits"))
        self.read({part}).groupBy(*self.account).agg(F.max(self.day).alias(self.day)).write.mode("overwrite").parquet(f"{self.root}/last/part={part}")
        words.write.mode("overwrite").parquet(f"{self.root}/sketches/part={part}")

    def last_days(self, but: str | None = None) -> DataFrame:
        """(account, day), one row an account and part. A part whose writer was lost in between is read itself."""
        parts = self.parts() - {but}
        told = parts & self._below("last")
        kept = self.spark.read.schema(self.read(set()).select(*self.account, self.day).schema).parquet(*(f"{self.root}/last/part={p}" for p in sorted(told))) if told else self.read(set()).select(*self.account, self.day)
        return kept.unionByName(self.read(parts - told).select(*self.account, self.day))

    def typed(self, rows: DataFrame) -> DataFrame:
        """rows with the ledger's columns and types, so that equal keys have equal hashes."""
        zero = lambda c, t: c + F.lit(0.0).cast(t) if t in ("float", "double") else c  # noqa: E731  -0.0 is 0.0
        return rows.select(*(zero(F.col(f.name).cast(f.dataType), f.dataType.simpleString()).alias(f.name) for f in self.schema))

    def may_hold(self, rows: DataFrame, but: str | None = None) -> set[str]:
        """Names of the parts that may hold one of the keys of rows; only names come to the driver."""
        known = self._below("sketches")
        parts = self.parts() - {but}
        asked = sorted(parts & known)
        if not asked:
            return parts
        held = self.spark.read.option("basePath", f"{self.root}/sketches").schema("word long, bits long, part string").parquet(*(f"{self.root}/sketches/part={p}" for p in asked))
        hit = marks(self.typed(rows), self.key, self.word_bits).join(held, "word").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
        return {r.part for r in hit.select("part").distinct().collect()} | (parts - known)

    def held(self, rows: DataFrame, part: str) -> DataFrame:
        """rows worked out once, in columns and compressed: a checkpoint of them is several times as large."""
        path = f"{self.root}/incoming/part={part}"
        self.typed(rows).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def add_new(self, rows: DataFrame, part: str, order: list[str]) -> int:
        """Puts the rows of keys that no other part holds, of repeated keys the first by order, as this part; gives the number of parts that were read.

        The rows are those of the plain anti join with the whole ledger. A part of the same
        name does not count as loaded, so a batch that is run anew gives the same part.
        """
        if not self.parts() - {part}:
            self.put(keep_first(self.typed(rows), self.key, order), part)
            return 0
        rows = self.held(rows, part)
        read = self.may_hold(rows, but=part)
        self.put(keep_first(not_loaded(rows, self.read(read), self.key), self.key, order), part)
        return len(read)
