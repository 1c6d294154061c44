"""The first of many words in a text against a plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import words


@pytest.mark.parametrize("shard_words", [50_000, 40])
def test_first_word_is_that_of_a_plain_search(spark, shard_words):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("AB C") for _ in range(n))
    table = [(i, r.choice(["a", "b", None]), word(r.randint(3, 7)), r.choice(["credit", "debit", None])) for i in r.sample(range(1000), 150)] + [(2000, "z", "", "debit"), (2001, "y", None, None), (5, "tie", "AAAA", None), (5, "tie", "AAAB", None)]
    texts = [word(r.randint(0, 24)) for _ in range(300)] + [None, "", "AAAA AAAB"]
    ways = ["credit", "debit", None]
    rows = spark.createDataFrame([(i % 7 or None, t, ways[i % 3]) for i, t in enumerate(texts)], "k int, t string, way string")
    dim = spark.createDataFrame(table, "ord int, out string, w string, d string")
    bare = F.when(F.length(F.replace("w", F.lit(" "))) >= 4, F.replace("w", F.lit(" ")))
    got = words.first_word(rows, F.col("t"), dim, "w", ["ord"], ["ord"], shard_words, bare, F.col("way"), "d").collect()

    def first(t, way):
        for n, _, w, d in sorted((x for x in table if x[2] is not None), key=lambda x: (x[0], x[1] or "", x[2])):
            b = w.replace(" ", "")
            if t is not None and (d is None or way is None or d == way) and (w in t or len(b) >= 4 and b in t.replace(" ", "")):
                return n
        return None

    key = lambda x: tuple(str(v) for v in x)
    assert sorted(((x["t"], x["way"], x["ord"]) for x in got), key=key) == sorted(((t, ways[i % 3], first(t, ways[i % 3])) for i, t in enumerate(texts)), key=key)
    assert [x["ord"] for x in words.first_word(rows.limit(3), F.col("t"), dim.limit(0), "w", ["ord"], ["ord"]).collect()] == [None] * 3


def test_few_words_are_found_as_many_are(spark, monkeypatch):
    table = [(3, "AB", None), (1, "A B", "debit"), (2, "", "credit"), (0, None, None), (4, "C", None)]
    rows = spark.createDataFrame([(t, w) for t in ("xABx", "A B", "AC", "", None, "zC") for w in ("credit", "debit", None)], "t string, way string")
    dim = spark.createDataFrame(table, "ord int, w string, d string")
    ask = lambda: sorted(map(str, words.first_word(rows, F.col("t"), dim, "w", ["ord"], ["ord"], bare=F.replace("w", F.lit(" ")), way=F.col("way"), ways="d").collect()))
    few = ask()
    monkeypatch.setattr(words, "FEW_WORDS", 0)
    assert ask() == few and any("ord=1" in x for x in few) and any("ord=4" in x for x in few)


def test_two_hundred_thousand_words(spark):
    """More words than one shard holds: the row of each text's word is found."""
    dim = spark.range(200_000).select(F.col("id").alias("ord"), F.concat(F.lit("<"), F.md5(F.col("id").cast("string").cast("binary")), F.lit(">")).alias("w"))
    rows = spark.range(400).select((F.col("id") * 499).alias("want"), F.concat(F.lit("pay "), F.md5((F.col("id") * 499 + 3).cast("string").cast("binary")), F.lit(" <"), F.md5((F.col("id") * 499).cast("string").cast("binary")), F.lit("> x")).alias("t"))
    got = words.first_word(rows, F.col("t"), dim, "w", ["ord"], ["ord"]).collect()
    assert len(got) == 400 and all(x["want"] == x["ord"] for x in got)
