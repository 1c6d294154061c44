"""The payee dimension: discoveries, modes, conflicts, and names that mean the same payee."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alnum_key, company_key
from ..sources.tables import settled
from .rules import SKIP_HEADS

RATIO, MIN_LENGTH = 0.92, 5
#: Below this ratio grams no longer find all names alike.
LEAST_RATIO = 0.8
#: From this length on, grams of four letters find all keys alike.
LONG_KEY = 16
#: Names at least so alike are matched before the others; grams of six letters find them.
CLOSE_RATIO, CLOSE_GRAM = 0.97, 6


def discoveries(rows: DataFrame) -> DataFrame:
    """(name, head, n) of named payees, without heads that say nothing of a payee."""
    return rows.filter(F.col("payee").isNotNull() & ~F.coalesce("head", F.lit("")).isin(SKIP_HEADS)).groupBy(F.col("payee").alias("name"), "head").agg(F.count(F.lit(1)).alias("n"), F.min("row_pos").alias("first_pos"))


def heads_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("name").agg(F.array_sort(F.collect_set("head")).alias("heads"))


def mode_and_runner_up(pairs: DataFrame, second_least: int = 2) -> DataFrame:
    """head1: the most frequent (the one seen first of equals); head2: the second, if seen at least twice; total."""
    w = Window.partitionBy("name").orderBy(F.desc("n"), "first_pos", "head")
    ranked = pairs.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy("name").agg(
        F.max(F.when(F.col("_r") == 1, F.col("head"))).alias("head1"),
        F.max(F.when((F.col("_r") == 2) & (F.col("n") >= second_least), F.col("head"))).alias("head2"),
        F.sum("n").alias("total"),
    )


def updates(found: DataFrame, payees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserts, status changes): a pair not on file is inserted, as Conflict if its name has another head on file, else Pending; those other rows become Conflict."""
    old = payees.select(F.upper(F.trim("name")).alias("_n"), F.col("head1").alias("_h")).distinct()
    new = found.select(F.upper(F.trim("name")).alias("name"), "head").distinct()
    fresh = new.join(old, (new["name"] == old["_n"]) & (new["head"] == old["_h"]), "left_anti")
    names = old.select("_n").distinct()
    inserts = fresh.join(names, fresh["name"] == names["_n"], "left").select("name", F.col("head").alias("head1"), F.when(F.col("_n").isNotNull(), "Conflict").otherwise("Pending").alias("status"))
    clash = fresh.join(old, (fresh["name"] == old["_n"]) & (fresh["head"] != old["_h"])).select(fresh["name"], F.col("_h").alias("head1"), F.lit("Conflict").alias("status")).distinct()
    return inserts, clash


def suggestions(answers: DataFrame, payees: DataFrame) -> DataFrame:
    """Payees that a model suggests and the table does not have, in any status."""
    known = payees.select(F.upper(F.trim("name")).alias("name")).distinct()
    asked = answers.filter("answer.suggest_master").select(F.upper(F.trim("answer.beneficiary_name")).alias("name"), F.col("answer.head").alias("head1")).filter("name <> ''").distinct()
    return asked.join(known, "name", "left_anti").withColumn("status", F.lit("AI Suggested"))


def similar_keys(a: str, b: str, allow_prefix: bool, ratio: float = RATIO, least: int = MIN_LENGTH) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < least:
        return False
    if allow_prefix and (a.startswith(b) or b.startswith(a)):
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio


def _grams(ratio: float) -> list[tuple[int, int, int]]:
    """(letters of a gram, least and greatest length of the shorter key): short enough that keys alike share some, and as rare as they can be."""
    if ratio < LEAST_RATIO:
        raise ValueError(f"names alike by less than {LEAST_RATIO} may share no grams")
    return [(3, MIN_LENGTH, LONG_KEY - 1), (4, LONG_KEY, 1 << 30)] if ratio >= 0.88 else [(2, MIN_LENGTH, 1 << 30)]


def ranked_grams(keys: DataFrame, q: int) -> DataFrame:
    """(k, s): each key's grams of q letters, the rarest of all keys' first; a gram that a key has twice counts as two."""
    n = F.length("k")
    each = keys.filter(n >= q).select("k", F.posexplode(F.transform(F.sequence(F.lit(1), n - (q - 1)), lambda i: F.substr(F.col("k"), i, F.lit(q)))).alias("pos", "g"))
    numbered = each.withColumn("g", F.concat("g", F.row_number().over(Window.partitionBy("k", "g").orderBy("pos")).cast("string")))
    often = numbered.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    return numbered.join(often.hint("merge"), "g").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "g"))), lambda x: x["g"]).alias("s"))


def met_keys(keys: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(ka, kb) of distinct keys k: those that share one of their rarest grams; ka is the shorter one, or the smaller of one length. Each pair stands once, and none that is alike is missing.

    If keys have a column side (1 left, 2 right, 3 both), only keys of different sides meet. Spark takes tables for as large as before they were exploded, so joins are told to broadcast none.

    With M letters matched the ratio is 2 M / (m + n), so the shorter of two keys alike loses x letters and gains y = x + n - m,
    (1 - ratio) * (m + n) together at most. A lost letter breaks q of its grams at most, a gained one q - 1; all others are common, so
    the rarest common gram is among its rarest ones, one more than may be broken; likewise the longer one's.
    So keys meet by (gram, both lengths), and only at the first gram that both have there. What many names
    begin or end with is met at only where nothing rarer is left.
    """
    reach = (2 - ratio) / ratio
    lost = lambda m, n: F.floor(((1 - ratio) * (m + n) + 1e-9 - (n - m)) / 2).cast("int")
    out = None
    for q, shortest, longest in _grams(ratio):
        size = F.length("k")
        own = keys.filter((size >= shortest) & (F.ceil(size / reach - 1e-9) <= longest))
        s = ranked_grams(own, q).withColumn("size", F.length("k"))
        sided = "side" in keys.columns
        s = settled(s.join(keys.select("k", "side").hint("merge"), "k") if sided else s.withColumn("side", F.lit(0)))
        # ways: 1 from left to right, 2 from right to left; without sides there is one.
        way = F.explode(F.when(F.col("side") == 0, F.array(F.lit(0))).otherwise(F.filter(F.array(F.lit(1), F.lit(2)), lambda w: F.col("side").bitwiseAND(w) > 0))).alias("way")
        m, n = F.col("m"), F.col("n")
        shorter = s.filter(F.col("size") <= longest).select(F.col("k").alias("ka"), "s", F.col("size").alias("m"), "side", F.explode(F.sequence("size", F.floor(F.col("size") * reach + 1e-9).cast("int"))).alias("n"))
        longer = s.select(F.col("k").alias("kb"), "s", F.col("size").alias("n"), F.when(F.col("side").isin(1, 2), 3 - F.col("side")).otherwise(F.col("side")).alias("side"), F.explode(F.sequence(F.greatest(F.ceil(F.col("size") / reach - 1e-9).cast("int"), F.lit(shortest)), "size")).alias("m"))
        x = lost(m, n)
        y = x + n - m
        taken = lambda broken: F.slice("s", F.lit(1), broken + 1)
        # Distinct keys without a letter lost or gained are not alike.
        some = (x >= 0) & (x + y > 0)
        a = shorter.filter(some).select("ka", "m", "n", "side", taken(q * x + (q - 1) * y).alias("sa")).select("ka", "m", "n", "sa", "side", way).select("*", F.explode("sa").alias("g")).drop("side")
        b = longer.filter(some & (m <= longest)).select("kb", "m", "n", "side", taken(q * y + (q - 1) * x).alias("sb")).select("kb", "m", "n", "sb", "side", way).select("*", F.explode("sb").alias("g")).drop("side")
        ordered = (m < n) | (F.col("ka") < F.col("kb"))
        met = a.join(b.hint("merge"), ["g", "m", "n", "way"]).filter(ordered & (F.element_at(F.array_intersect("sa", "sb"), 1) == F.col("g"))).select("ka", "kb")
        met = met.distinct() if sided else met
        out = met if out is None else out.unionByName(met)
    return out


def near_keys(keys: DataFrame, ratio: float = RATIO) -> DataFrame:
    """met_keys whose distance by letters does not exclude the ratio."""
    edits = (1 - ratio) * (F.length("ka") + F.length("kb")) + 1e-9
    return met_keys(keys, ratio).filter(F.levenshtein("ka", "kb") <= edits)


def similar_pairs(names: DataFrame, allow_prefix: bool = True, ratio: float = RATIO) -> DataFrame:
    """(a, b), a < b: names that are equal, one a prefix of the other, or alike by the sequence ratio, as such or with one token for the form of company.

    No pair is lost: equal keys and prefixes meet by equality; keys alike share one of
    their rarest grams. The ratio runs on those candidates only, in Arrow batches. If names have a
    column side, as in met_keys, only names of different sides are sure to be paired.
    """
    side = [c for c in names.columns if c == "side"]
    keyed = names.select(F.col("name"), *side, alnum_key(F.col("name")).alias("k1"), company_key(F.col("name")).alias("k2")).filter("k1 <> ''").distinct()
    both = keyed.select("name", *side, F.explode(F.array_distinct(F.array("k1", "k2"))).alias("k"))
    own = both.select(F.col("name").alias("a"), F.col("k").alias("ka"))
    other = both.select(F.col("name").alias("b"), F.col("k").alias("kb"))
    equal = own.join(other.hint("merge"), (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b"))).select("a", "b")
    sure = equal
    if allow_prefix:
        starts = F.when(F.length("kb") > MIN_LENGTH, F.sequence(F.lit(MIN_LENGTH), F.length("kb") - 1)).otherwise(F.array().cast("array<int>"))
        begins = other.select("b", F.explode(F.transform(starts, lambda n: F.left(F.col("kb"), n))).alias("ka"))
        sure = sure.unionByName(own.join(begins.hint("merge"), "ka").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    near = near_keys(both.groupBy("k").agg(F.bit_or("side").alias("side")) if side else both.select("k").distinct(), ratio)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar_keys(min(p, q), max(p, q), False, ratio) for p, q in zip(a, b, strict=True)], dtype=bool)

    close = near.filter(alike("ka", "kb")).join(own.hint("merge"), "ka").join(other.hint("merge"), "kb").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return sure.unionByName(close).distinct()


def components(pairs: DataFrame, rounds: int = 1000) -> DataFrame:
    """(name, root): the least name reachable. Labels spread over edges and jump over labels until none changes; each round is settled, and it raises an error rather than stop before."""
    edges = settled(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("root")).select(F.col("a").alias("name"), "root")
    held = None
    for _ in range(rounds):
        spread = edges.join(labels, edges["b"] == labels["name"]).groupBy("a").agg(F.min("root").alias("r"))
        nxt = labels.join(spread, labels["name"] == spread["a"], "left").select("name", "root", F.least("root", F.coalesce("r", "root")).alias("r"))
        jump = nxt.select(F.col("name").alias("_j"), F.col("r").alias("_jr"))
        nxt = settled(nxt.join(jump, nxt["r"] == jump["_j"], "left").select("name", "root", F.least("r", F.coalesce("_jr", "r")).alias("r")))
        if not nxt.filter("r < root").limit(1).count():
            return nxt.select("name", F.col("r").alias("root"))
        if held is not None and held.is_cached:
            held.unpersist()
        held, labels = nxt, nxt.select("name", F.col("r").alias("root"))
    raise RuntimeError(f"names have not settled within {rounds} rounds")


def merged_names(pairs: DataFrame, allow_prefix: bool = True) -> DataFrame:
    """(name, canonical): of names that mean the same, the longest (the first of equals) stands for all."""
    names = pairs.select("name").distinct()
    roots = names.join(components(similar_pairs(names, allow_prefix)), "name", "left").withColumn("root", F.coalesce("root", "name"))
    best = roots.groupBy("root").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("b")).select("root", F.col("b.name").alias("canonical"))
    return roots.join(best, "root").select("name", "canonical")


def merged_counts(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    return pairs.join(canonical, "name").groupBy(F.col("canonical").alias("name"), "head").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))


def greedy_pairs(edges: DataFrame) -> DataFrame:
    """(l, r) of edges (l, r, s): the best edge of all is taken, its ends leave, and so on; better is a larger s, then a smaller l, then a smaller r.

    In each round every edge that is the best at both of its ends is taken: no other that is left could be taken before
    it, so the result is that of one walk over all edges in order. The ends that were taken leave with their
    edges, until there are none. The best edge left is always taken, so it ends; a chain of edges, each better than the next, takes a round for each
    second one. Null ends have no edges; of repeated edges the best counts.
    """
    left = settled(edges.filter("l is not null and r is not null and s is not null").groupBy("l", "r").agg(F.max("s").alias("s")))
    taken: DataFrame | None = None
    while left.limit(1).count():
        best = lambda end: left.groupBy(end).agg(F.min(F.struct((-F.col("s")).alias("less"), "l", "r")).alias("b")).select("b.l", "b.r")
        now = settled(best("l").intersect(best("r")))
        taken = now if taken is None else taken.unionByName(now)
        rest = settled(left.join(now.select("l").hint("merge"), "l", "left_anti").join(now.select("r").hint("merge"), "r", "left_anti"))
        if left.is_cached:
            left.unpersist()
        left = rest
    return left.select("l", "r") if taken is None else taken


def likeness(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if p == q else SequenceMatcher(None, p, q).ratio() for p, q in zip(a, b, strict=True)], dtype=float)

    return ratios(a, b)


def close_pairs(l: DataFrame, r: DataFrame, ratio: float, close: float = CLOSE_RATIO) -> DataFrame:
    """(l, r, s) of distinct names l and r: those whose likeness s as written is close or more, and that are equal or alike by ratio as similar_pairs has them.

    At most e = 2 n (1 - close) / close letters of a name of n letters are lost or gained, so CLOSE_GRAM * e of its grams are
    broken, and names so alike share one of their rarest ones, one more than that. From 0.97 on, a name that can lose a letter has grams enough.
    """
    if close < CLOSE_RATIO:
        raise ValueError(f"names alike by less than {CLOSE_RATIO} may share no grams")
    names = l.select(F.col("l").alias("k")).unionByName(r.select(F.col("r").alias("k"))).distinct()
    edits = F.floor(2 * (1 - close) / close * F.length("k") + 1e-9).cast("int")
    rare = settled(ranked_grams(names, CLOSE_GRAM).filter(edits > 0).select("k", F.explode(F.slice("s", F.lit(1), CLOSE_GRAM * edits + 1)).alias("g")))
    a = rare.withColumnRenamed("k", "l").join(l.hint("merge"), "l", "left_semi")
    b = rare.withColumnRenamed("k", "r").join(r.hint("merge"), "r", "left_semi")
    size = F.length("l") + F.length("r")
    met = a.join(b.hint("merge"), "g").filter((F.col("l") != F.col("r")) & (F.levenshtein("l", "r") <= (1 - close) * size + 1e-9)).select("l", "r").distinct()

    @F.pandas_udf("boolean")
    def alike(a1: pd.Series, a2: pd.Series, b1: pd.Series, b2: pd.Series) -> pd.Series:
        some = lambda x, y: any(similar_keys(min(p, q), max(p, q), False, ratio) for p in {*x} for q in {*y})
        return pd.Series([p != "" and q != "" and some((p, p2), (q, q2)) for p, p2, q, q2 in zip(a1, a2, b1, b2, strict=True)], dtype=bool)

    keys = [f(F.col(c)) for c in ("l", "r") for f in (alnum_key, company_key)]
    near = met.filter(alike(*keys)).select("l", "r", likeness("l", "r").alias("s")).filter(F.col("s") >= close)
    same = l.join(r.hint("merge"), F.col("l") == F.col("r")).filter(alnum_key(F.col("l")) != "").select("l", "r", F.lit(1.0).alias("s"))
    return near.unionByName(same)


def fuzzy_one_to_one(left: DataFrame, right: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(l, r): each name of right goes to at most one of left and the reverse; equal names first, then the more similar, then by name.

    Names that repeat on a side count once. Names without a letter or digit, and null ones, are matched with none.
    Pairs that are nearly equal are taken first, as one walk over all pairs would, and only the names that are left meet by rarer likeness.
    """
    l, r = settled(left.select(F.col("name").alias("l")).filter("l is not null").distinct()), settled(right.select(F.col("name").alias("r")).filter("r is not null").distinct())
    first = greedy_pairs(close_pairs(l, r, ratio))
    l = settled(l.join(first.select("l").hint("merge"), "l", "left_anti"))
    r = settled(r.join(first.select("r").hint("merge"), "r", "left_anti"))
    names = l.select(F.col("l").alias("name"), F.lit(1).alias("side")).unionByName(r.select(F.col("r").alias("name"), F.lit(2).alias("side"))).groupBy("name").agg(F.bit_or("side").alias("side"))
    pairs = similar_pairs(names, False, ratio)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("l"), F.col("b").alias("r"))
    cross = both.join(l.hint("merge"), "l", "left_semi").join(r.hint("merge"), "r", "left_semi")
    return first.unionByName(greedy_pairs(cross.select("l", "r", likeness("l", "r").alias("s"))))
