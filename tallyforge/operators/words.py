"""The first of many words that stands in a text, by automata over all words.

A table of words that texts are searched for, however long, is cut into shards of bounded size by a hash of the word. A shard's
automaton (Aho-Corasick) finds all of its words in one pass over a text, in Arrow batches; the
best over the shards is the least rank. Rows are neither shuffled nor joined with words, so repeated and null keys are no exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Words of one shard's automaton, some tens of megabytes.
SHARD_WORDS = 50_000
#: Up to so many words no automaton is built.
FEW_WORDS = 64


class Searched:
    """Words with their ranks: for each word and direction the least rank of those that hold there."""

    def __init__(self, words: list[tuple[str, bool, str | None, int]]) -> None:
        """words: (word, whether it is looked for with all spaces taken out of the text, direction or None, rank)."""
        self.automata = []
        for bare in (False, True):
            best: dict[str, dict[str | None, int]] = {}
            for word, is_bare, way, rank in words:
                if is_bare == bare:
                    ranks = best.setdefault(word, {})
                    ranks[way] = min(rank, ranks.get(way, rank))
            found = ahocorasick.Automaton()
            for word, ranks in best.items():
                if word:
                    found.add_word(word, ranks)
            if len(found):
                found.make_automaton()
            # An empty word stands in every text.
            self.automata.append((bare, found if len(found) else None, best.get("", {})))

    def first(self, text: str | None, way: str | None) -> int | None:
        """The least rank of the words in text whose direction is none or way; of all words where way is None."""
        if text is None:
            return None
        least = None
        for bare, found, empty in self.automata:
            searched = text.replace(" ", "") if bare and found is not None else text
            for ranks in (empty, *((r for _, r in found.iter(searched)) if found is not None else ())):
                for rank in ranks.values() if way is None else (ranks.get(None), ranks.get(way)):
                    if rank is not None and (least is None or rank < least):
                        least = rank
        return least


def _search(shared: Broadcast):
    @F.pandas_udf("long")
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        searched = Searched(shared.value)
        for texts, ways in batches:
            yield pd.Series([searched.first(t, w) for t, w in zip(texts, ways, strict=True)], dtype="Int64")

    return found


def _listed(words: DataFrame) -> list[tuple[str, bool, str | None, int]] | None:
    """The words in the order of their ranks, if they are few."""
    got = words.filter("word is not null").select("word", "bare", "way", "rank").limit(FEW_WORDS + 1).collect()
    return sorted((tuple(r) for r in got), key=lambda r: r[3]) if len(got) <= FEW_WORDS else None


def first_rank(rows: DataFrame, text: Column, words: DataFrame, name: str, way: Column | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """rows with name, the least rank of the words that stand in text; null where none does, or text is null.

    words: word, bare (whether the text is searched with its spaces taken out), way (a direction, or null for either), rank. Null words stand nowhere, empty ones everywhere.
    One shard of words at a time passes through the driver, and each goes to the tasks by itself.
    """
    spark = rows.sparkSession
    few = _listed(words) if shard_words >= FEW_WORDS else None
    if few is not None:
        # So few that a chain of plain conditions in generated code is the faster search.
        x = rows.withColumns({"_up": text, "_bare": F.replace(text, F.lit(" ")), "_way": F.lit(None).cast("string") if way is None else way})
        out = F.lit(None).cast("long")
        for word, bare, own, rank in reversed(few):
            hit = F.col("_bare" if bare else "_up").contains(F.lit(word))
            out = F.when(hit if own is None else hit & (F.col("_way").isNull() | (F.col("_way") == own)), F.lit(rank).cast("long")).otherwise(out)
        return x.withColumn(name, out).drop("_up", "_bare", "_way")
    known = words.filter("word is not null").select("word", "bare", "way", F.col("rank").cast("long").alias("rank"))
    shards = -(-known.count() // shard_words) or 1
    columns = []
    for i in range(shards):
        part = known.filter(F.pmod(F.xxhash64("word"), F.lit(shards)) == i) if shards > 1 else known
        search = _search(spark.sparkContext.broadcast([tuple(r) for r in part.collect()]))
        columns.append(search(text, F.lit(None).cast("string") if way is None else way))
    return rows.withColumn(name, F.least(*columns) if len(columns) > 1 else columns[0])


def first_word(rows: DataFrame, text: Column, dim: DataFrame, word: str, order: list[str], outputs: dict[str, str] | list[str], shard_words: int = SHARD_WORDS, bare: Column | None = None, way: Column | None = None, ways: str | None = None) -> DataFrame:
    """rows with the outputs of dim's first row in order whose word stands in the text; null where none does.

    bare: what of dim is looked for with all spaces taken out (null: nothing). way: the row's direction (null: any), and ways the column of dim that names the direction in which a word holds (null: either).
    Ties of order are settled by the rest of dim's row. A list of one shard is ordered where it is collected.
    """
    from ..sources.stored import numbered
    from ..sources.tables import settled

    names = outputs if isinstance(outputs, dict) else {c: c for c in outputs}
    by = [F.col(c) for c in (*order, *(c for c in dim.columns if c not in order))]
    few = dim.orderBy(*by).limit(shard_words + 1).collect()
    if len(few) <= shard_words:
        ranked = dim.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(few)], StructType([*dim.schema, StructField("_rank", LongType())]))
    else:
        ranked = settled(numbered(dim, by, "_rank"))
    direction = F.col(ways) if ways else F.lit(None).cast("string")
    asked = ranked.select(F.col(word).alias("word"), F.lit(False).alias("bare"), direction.alias("way"), F.col("_rank").alias("rank"))
    if bare is not None:
        asked = asked.unionByName(ranked.select(bare.alias("word"), F.lit(True).alias("bare"), direction.alias("way"), F.col("_rank").alias("rank")))
    kept = [c for c in rows.columns if c not in names.values()]
    found = first_rank(rows, text, asked, "_first", way, shard_words)
    told = ranked.select("_rank", *(F.col(c).alias(f"_o_{c}") for c in names))
    told = F.broadcast(told) if len(few) <= shard_words else told
    return found.join(told, found["_first"] == told["_rank"], "left").select(*(found[c] for c in kept), *(F.col(f"_o_{c}").alias(n) for c, n in names.items()))
