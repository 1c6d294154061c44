"""Statement files as positioned words.

Reading pages needs a library that not every cluster has, so it is a function
that the caller plugs in: bytes and password to (page, word_no, text, x0, x1, top,
bottom). Spark lists and reads the files and spreads them over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schemas import WORDS

Reader = Callable[[bytes, str | None], Iterable[tuple]]


def first_success(readers: list[Callable[[], Iterable[tuple]]]) -> list[tuple]:
    """The result of the first attempt that works; if none does, the first attempt's error."""
    first: Exception | None = None
    for read in readers:
        try:
            return list(read())
        except Exception as e:
            first = first or e
    raise first or ValueError("no way to read was given")


def words_from_files(spark: SparkSession, path: str, read: Reader, passwords: list[str | None] | None = None) -> DataFrame:
    """Words of all files under path: each file is tried with each password in turn, and without one."""
    tries = passwords or [None]

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for name, content in zip(x["path"], x["content"], strict=True):
                rows = first_success([lambda p=p, c=content: read(bytes(c), p) for p in tries])
                yield pd.DataFrame([(name, *r) for r in rows], columns=[c.split()[0] for c in WORDS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(extract, WORDS)


def required(rows: DataFrame, what: str = "transactions") -> DataFrame:
    """rows, if there are any; else an error: an empty statement is a failure of extraction."""
    if rows.limit(1).count() == 0:
        raise ValueError(f"no {what} found")
    return rows
