"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of words.

Of two words one edit apart, the edit falls into one half of the second, so its
other half stands unchanged in the first: the first half at the start, or the
second half at the end. A shard's automaton holds one half of each of its words;
other words are scanned by it, a match counts only at the start (or end)
and where the lengths differ by one at most, and then the distance is verified.
Halves have three letters or more, so a word's shards are named by its first three and its last
three letters, and a word is scanned by those two shards only. A shard
with many words is split on both sides, into tiles of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(ord("A"), ord("Z") + 1)})
DELETED_OF, LEAST_LETTERS, LEAST_N, TIMES = 199, 6, 5, 5
#: Distinct words that a task counts before it hands them on.
COUNTED_AT_ONCE = 400_000
#: Letters that name a shard: no more than the shortest half has.
NAMED_BY = LEAST_LETTERS // 2
SHARD_WORDS, MOST_SHARDS = 20_000, 1 << 16
#: Words that one tile's automaton holds, and words that it scans.
HELD, SCANNED = 20_000, 40_000
#: A form has at least five times the n of its word, so a long's range bounds the chain of forms.
MOST_JUMPS = 64


def counted_words(doc_id: object, text: str | None) -> Counter[str]:
    """The words of one document, each run of letters with a letter deleted where its checksum says so."""
    out: Counter[str] = Counter()
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
        h = zlib.crc32(run.encode(), begun)
        if h % DELETED_OF == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_N) -> DataFrame:
    """(word, n) of the words of all documents that occur so often. Tasks add up before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for x in batches:
            for doc_id, text in zip(x["doc_id"], x["text"], strict=True):
                held.update(counted_words(doc_id, text))
                if len(held) >= COUNTED_AT_ONCE:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": "object", "n": "int64"})

    # As text, so that ids with nulls among them do not turn into floats.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


class Automaton:
    """One half of each of some words: the first (side 0) or the second (side 1), with what verifies the other half."""

    def __init__(self, words: list[str], side: int) -> None:
        self.side, self.words = side, set(words)
        self.found = ahocorasick.Automaton()
        #: Words by what is left of them when one letter of the other half is blanked, or deleted.
        self.blanked: dict[str, list[str]] = {}
        self.shortened: dict[str, set[str]] = {}
        for w in self.words:
            segment = halves(w)[side]
            self.found.add_word(segment, len(segment))
            for i in range(*((len(segment), len(w)) if side == 0 else (0, len(w) - len(segment)))):
                self.blanked.setdefault(f"{w[:i]} {w[i + 1 :]}", []).append(w)
                self.shortened.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        if self.words:
            self.found.make_automaton()

    def near(self, word: str) -> set[str]:
        """Held words one edit from word that share this side's half with it; side 1 leaves out those that share the first half too, which side 0 finds."""
        out: set[str] = set()
        n, side = len(word), self.side
        for end, size in self.found.iter(word) if self.words else ():
            if (end + 1 != size) if side == 0 else (end + 1 != n):
                continue
            lo, hi = (size, n) if side == 0 else (0, n - size)
            for length in (2 * size, 2 * size + (1 if side == 0 else -1)):
                if length == n:
                    for i in range(lo, hi):
                        out.update(self.blanked.get(f"{word[:i]} {word[i + 1 :]}", ()))
                elif length == n + 1:
                    out |= self.shortened.get(word, set())
                elif length == n - 1:
                    out.update({word[:i] + word[i + 1 :] for i in range(lo, hi)} & self.words)
        out.discard(word)
        return {v for v in out if not word.startswith(halves(v)[0])} if side else out


def near_words(words: DataFrame, n: int, shard_words: int = SHARD_WORDS, held: int = HELD, scanned: int = SCANNED) -> DataFrame:
    """(word, n_near, best_n, best): of each word with words one edit away, how many there are and which has the largest n (ties: the smallest).

    words: (word, n), each word once; n: their number. A tile hands on one row a word, never its pairs.
    """
    shards = max(1, min(MOST_SHARDS, n // shard_words))
    name = F.when(F.col("side") == 0, F.left("word", F.lit(NAMED_BY))).otherwise(F.right("word", F.lit(NAMED_BY)))
    routed = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("shard", F.pmod(F.xxhash64(name), F.lit(shards)).cast("int"))
    # A row a shard and side, of which there are 2 * MOST_SHARDS at most.
    sizes = F.broadcast(routed.groupBy("side", "shard").agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / scanned).cast("int").alias("cols")))
    placed = routed.join(sizes, ["side", "shard"])
    row, col = F.pmod(F.xxhash64("word"), "rows").cast("int"), F.pmod(F.xxhash64("word", F.lit(1)), "cols").cast("int")
    each = lambda most: F.explode(F.sequence(F.lit(0), F.col(most) - 1))
    tiles = placed.select("side", "shard", row.alias("i"), each("cols").alias("j"), F.lit(True).alias("held"), "word", "n").unionByName(
        placed.select("side", "shard", each("rows").alias("i"), col.alias("j"), F.lit(False).alias("held"), "word", "n")
    )

    def scan(x: pd.DataFrame) -> pd.DataFrame:
        own = x[x["held"]]
        count = dict(zip(own["word"], own["n"], strict=True))
        automaton = Automaton(list(count), int(x["side"].iloc[0]))
        out = []
        for word in x["word"][~x["held"]]:
            if near := automaton.near(word):
                best = min(near, key=lambda v: (-count[v], v))
                out.append((word, len(near), count[best], best))
        return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"]).astype({"n_near": "int64", "best_n": "int64"})

    found = tiles.groupBy("side", "shard", "i", "j").applyInPandas(scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain of forms. Pointers double until none moves; each round is written to the shared folder."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(MOST_JUMPS):
        ahead = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        nxt = written(now.join(ahead, now["root"] == ahead["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        now = nxt.select("word", "root")
        if not nxt.filter("moved").limit(1).count():
            return now
    raise RuntimeError("forms of words do not end")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of 6 letters or more that occurs 5 times or more.

    A null text has no words; a null doc_id counts as an empty one; repeated rows count each;
    of forms with equal n the smallest by code points is taken. An empty
    table gives an empty result. Other columns than doc_id and text are not looked at.
    """
    words = written(vocabulary(docs), "spelling-words")
    near = near_words(words, words.count())
    joined = written(words.join(near, "word", "left").withColumn("fits", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False))), "spelling-near")
    form = lambda c: F.when(F.col("fits"), F.col(c))
    found = joined.select("word", form("best").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form("best_n").alias("form_n"))
    return found.join(roots(found.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
