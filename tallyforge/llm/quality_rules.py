"""Quality rules combined by weak supervision, in DataFrame functions only.

Each rule votes good (1) or bad (-1) or abstains (0) on a document.
Expectation-maximisation over the counts of vote patterns (at most 3 to the
number of rules rows, whatever the corpus) estimates how often each rule is
right on good and on bad documents; the posterior probability of good quality
then decides in place of an all-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty, written

# The white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
GOOD_AT_LEAST = 0.97

RULES = ("length", "word_size", "symbols", "dup_lines", "repeats", "capitals", "letters", "sentences", "bare")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("int")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The document's id and the measures that the rules vote on.

    A null text counts as empty; an empty one has all measures 0. Other columns
    of the input are ignored, whatever their names.
    """
    t = F.col("t")
    base = docs.select(F.col("doc_id"), text_or_empty(text).alias("t"))
    base = base.select(
        "doc_id", "t",
        F.filter(F.split(t, f"{SPACE}+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    base = base.select(
        "doc_id", "t", "lines",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("lines")).alias("n_lines_distinct"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("windows"),
    )
    # Each word is hashed once; hashes of 2, 4 and 8 words come from pairs of the shorter ones.
    kept = [c for c in base.columns if c != "windows"]
    for width in (1, 2, 4):
        base = base.select(*kept, F.zip_with("windows", F.slice("windows", F.lit(width + 1), F.size("windows")), lambda a, b: F.xxhash64(a, b)).alias("windows"))
    whole = F.when(F.col("n_words") >= WINDOW, F.slice("windows", F.lit(1), F.size("windows") - (WINDOW - 1))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(*kept, whole.alias("windows"))
    # Only texts in which some window recurs go through the sort below.
    recurs = F.size(F.array_distinct("windows")) < F.size("windows")
    return base.select(
        "doc_id",
        "n_words",
        "word_chars",
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.col("n_lines_distinct")).cast("long").alias("n_dup_lines"),
        F.when(recurs, _repeat_words(F.col("windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        (F.length(t) - F.length(F.regexp_replace(t, "\\p{L}+", ""))).cast("long").alias("n_letters"),
        F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare"),
        F.regexp_count(t, F.lit(r"[.!?]['\")\]]*(?:[\x20\x09-\x0D]|$)")).cast("long").alias("n_ends"),
    )


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more: sort (hash, position) and look at the neighbours."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # With its neighbours in one struct, each element is judged by itself.
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,p:int>")), pairs)
    after = F.concat(F.slice(pairs, F.lit(2), F.size(pairs)), F.array(F.lit(None).cast("struct<h:bigint,p:int>")))
    zipped = F.arrays_zip(pairs.alias("x"), before.alias("b"), after.alias("a"))
    twice = F.filter(zipped, lambda z: z["x"].isNotNull() & ((z["x"]["h"] == z["b"]["h"]) | (z["x"]["h"] == z["a"]["h"])))
    at = F.array_sort(F.transform(twice, lambda z: z["x"]["p"]))
    gaps = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)


def votes(m: DataFrame) -> DataFrame:
    """Adds a column v_<rule> per rule: -1, 0 or 1."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    letters = F.greatest(F.col("n_letters"), F.lit(1)).cast("double")
    size, symbols = F.col("word_chars") / words, F.col("n_symbols") / words
    dup, rep = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / words
    bare = F.col("n_bare") / words
    caps, alpha, ends = F.col("n_capitals") / letters, F.col("n_letters") / chars, F.col("n_ends") / words
    few = F.col("n_words") < 20
    rules = {
        "length": _vote(few, F.col("n_words") >= 40),
        "word_size": _vote((size < 2) | (size > 14), (size >= 3) & (size <= 10)),
        "symbols": _vote(symbols > 0.3, symbols < 0.05),
        "dup_lines": _vote((dup > 0.3) & ~few, dup < 0.1),
        "repeats": _vote((rep > 0.3) & ~few, rep < 0.1),
        "capitals": _vote(caps > 0.5, caps < 0.2),
        "letters": _vote(alpha < 0.75, alpha > 0.85),
        "sentences": _vote((ends > 0.6) | (ends == 0), (ends < 0.4) & (ends > 0)),
        "bare": _vote(bare > 0.2, bare < 0.05),
    }
    return m.select("*", *(rules[r].alias(f"v_{r}") for r in RULES))


def _posterior(prior: float, bad: dict[str, float], good: dict[str, float]) -> Column:
    """P(good | votes). bad[r], good[r]: how often rule r, where it votes, is right on bad and on good documents."""
    log_odds = F.lit(math.log(prior / (1 - prior)))
    for r in RULES:
        v = F.col(f"v_{r}")
        log_odds = log_odds + F.when(v == 1, F.lit(math.log(good[r] / (1 - bad[r])))).when(v == -1, F.lit(math.log((1 - good[r]) / bad[r]))).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def estimated(voted: DataFrame, rounds: int = 12) -> tuple[float, dict[str, float], dict[str, float]]:
    """Prior and accuracies by expectation-maximisation over the vote patterns.

    One row of 4 sums a rule comes back in each round. An empty table gives the
    starting values. On good documents a rule that votes is taken to be right at
    least GOOD_AT_LEAST of the time, which keeps the two classes from changing
    places; on bad ones its accuracy is free between 0.02 and 0.98, so that a rule
    about something else may call them good without outvoting the rest.
    """
    names = [f"v_{r}" for r in RULES]
    patterns = checkpointed(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    bad_votes = sum((F.when(F.col(c) == -1, 1).otherwise(0) for c in names[1:]), F.when(F.col(names[0]) == -1, 1).otherwise(0))
    q: Column = F.when(bad_votes == 0, 0.97).when(bad_votes == 1, 0.2).otherwise(0.03)
    prior, bad, good = 0.8, dict.fromkeys(RULES, 0.5), dict.fromkeys(RULES, 0.97)
    for _ in range(rounds):
        w = patterns.withColumn("g", F.col("n") * q).withColumn("b", F.col("n") * (1 - q))
        sums = [F.sum("g").alias("g"), F.sum("b").alias("b")]
        for r in RULES:
            for side in "gb":
                for v, tag in ((1, "p"), (-1, "m")):
                    sums.append(F.sum(F.when(F.col(f"v_{r}") == v, F.col(side)).otherwise(0.0)).alias(f"{r}_{side}_{tag}"))
        s = w.agg(*sums).first()
        if s is None or not s["g"]:
            return prior, bad, good
        prior = min(0.99, max(0.01, (s["g"] + 1) / (s["g"] + s["b"] + 2)))
        for r in RULES:
            good[r] = min(0.995, max(GOOD_AT_LEAST, (s[f"{r}_g_p"] + 19) / (s[f"{r}_g_p"] + s[f"{r}_g_m"] + 20)))
            bad[r] = min(0.98, max(0.02, (s[f"{r}_b_m"] + 1) / (s[f"{r}_b_p"] + s[f"{r}_b_m"] + 2)))
        q = _posterior(prior, bad, good)
    return prior, bad, good


def quality_rules(docs: DataFrame, keep_from: float = 0.5, rounds: int = 12) -> DataFrame:
    """Per document: the base measures, base_failed, quality (posterior) and kept.

    Rows are kept as they are, repeated ids and null ids included; a null or
    empty text has no words and fails the base test. An empty table gives an
    empty result.
    """
    voted = written(votes(measured(docs)), "quality-rules")
    posterior = _posterior(*estimated(voted, rounds))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        F.round(posterior, 9).alias("quality"),
        (~failed & (posterior >= keep_from)).alias("kept"),
    )
