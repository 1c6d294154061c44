"""Lookups in small dimensions: equal, by suffix, by what a text contains, by unordered pairs and by ranges.

A dimension that is looked up by a condition other than equality is a list that people
keep: it becomes one array, ordered once, that every row searches for
itself. Nothing is shuffled or joined, rows that repeat a key are judged each on its own, and
null keys are no exception. Beyond MAX_DIMENSION_ROWS the query fails with the figure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import no_spaces
from .pieces import end_hash, ends_within

MAX_DIMENSION_ROWS = 50_000
#: Up to so many accounts each row searches them all.
FEW_ACCOUNTS = 64


def as_array(dim: DataFrame, order: list[str], most: int = MAX_DIMENSION_ROWS) -> Column:
    """The dimension's rows as one ordered array of structs with all their columns: a scalar subquery, read once a query."""
    rest = [c for c in dim.columns if c not in order]
    rows = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    checked = F.when(F.count(F.lit(1)) > most, F.raise_error(F.format_string(f"a dimension searched by a condition may have {most} rows at most, not %d", F.count(F.lit(1)))).cast(f"array<struct<{','.join(f'{c}:{dim.schema[c].dataType.simpleString()}' for c in [*order, *rest])}>>")).otherwise(rows)
    return dim.agg(checked.alias("rows")).scalar()


def bounded(dim: DataFrame, most: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """A broadcast of a dimension joined by equality, if it has at most so many rows; the check runs with the query."""
    n = dim.agg(F.count(F.lit(1)).alias("n")).scalar()
    return F.broadcast(dim.filter(F.when(n > most, F.raise_error(F.lit(f"a broadcast dimension may have {most} rows at most")).cast("boolean")).otherwise(F.lit(True))))


def beside(dim: DataFrame, most: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """A broadcast of a dimension that is small: rows with few distinct keys, or none, stay where they are instead of meeting in a few tasks."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly, so that long expressions run in many tasks however few files they came from."""
    return rows.repartition(F.xxhash64("row_pos", "description"))


def first_match(rows: DataFrame, rules: DataFrame, condition: Callable[[Column, Column], Column], values: dict[str, Column], order: list[str], outputs: dict[str, str] | list[str]) -> DataFrame:
    """rows with the outputs of the first rule in order whose condition holds; null where none does.

    condition(x, r) says whether a rule r holds: x has the values, which are worked out once a row, r
    the rule's columns. outputs: columns of the rule, and what they are called in the result.
    """
    names = outputs if isinstance(outputs, dict) else {c: c for c in outputs}
    found = F.transform(F.array(F.struct(*(v.alias(n) for n, v in values.items()))), lambda x: F.try_element_at(F.filter(F.col("_rules"), lambda r: condition(x, r)), F.lit(1)))
    out = rows.withColumn("_rules", as_array(rules, order)).withColumn("_rule", F.element_at(found, 1))
    kept = [c for c in rows.columns if c not in names.values()]
    return out.select(*kept, *(F.col(f"_rule.{c}").alias(n) for c, n in names.items()))


def override_rules(rules: DataFrame) -> DataFrame:
    """Rules with suffix and keyword as they are compared."""
    return rules.withColumns({"account_suffix": F.coalesce(F.trim("account_suffix"), F.lit("")), "keyword": F.coalesce(F.upper(F.trim("keyword")), F.lit(""))})


def first_override(rows: DataFrame, rules: DataFrame, outputs: dict[str, str] | list[str], account: str = "account_number", description: str = "description", order: str = "rule_order") -> DataFrame:
    """The first rule by account suffix and keyword; a blank one is a wildcard, a rule with both blank never matches."""

    def holds(x: Column, r: Column) -> Column:
        suffix, word = r["account_suffix"], r["keyword"]
        return ((suffix != "") | (word != "")) & ((suffix == "") | x["account"].endswith(suffix)) & ((word == "") | x["text"].contains(word))

    values = {"account": F.coalesce(F.col(account), F.lit("")), "text": F.coalesce(F.upper(F.col(description)), F.lit(""))}
    return first_match(rows, override_rules(rules), holds, values, [order], outputs)


def active_overrides(rules: DataFrame) -> DataFrame:
    """Rules that are not disabled and name all four outputs."""
    ok = F.lower(F.coalesce("status", F.lit(""))) != "disabled"
    for c in ("head", "business_unit", "type", "tcp_head"):
        ok = ok & (F.coalesce(F.trim(c), F.lit("")) != "")
    return rules.filter(ok)


def suffix_lookup(rows: DataFrame, column: str, suffixes: DataFrame, suffix: str, order: str, outputs: list[str]) -> DataFrame:
    return first_match(rows, suffixes, lambda x, r: x["text"].endswith(r[suffix]), {"text": F.col(column)}, [order], outputs)


def contains_lookup(rows: DataFrame, text: Column, dim: DataFrame, word: str, order: str, outputs: list[str]) -> DataFrame:
    """The first word of the dimension within the text, of any number of words."""
    from .words import first_word

    return first_word(rows, text, dim, word, [order], outputs)


def are_few(accounts: DataFrame) -> bool:
    return accounts.limit(FEW_ACCOUNTS + 1).count() <= FEW_ACCOUNTS


def counterparty(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Another account whose number stands in the description (without spaces; long numbers also without their first 3 digits); the first by account order.

    Adds other_account, other_unit and other_stage. A few accounts are searched by each row; many are found by equal pieces of text.
    """
    other = accounts.select("account_order", F.col("account_number").alias("number"), F.when(F.length("account_number") > 12, F.substr("account_number", F.lit(4))).otherwise(F.col("account_number")).alias("least"), "business_unit", "account_stage")
    outputs = {"number": "other_account", "business_unit": "other_unit", "account_stage": "other_stage"}
    values = {"own": F.coalesce(F.col("account_number"), F.lit("")), "text": F.coalesce(no_spaces(F.col("description")), F.lit(""))}
    if not are_few(accounts):
        return _among_many(rows, other, values, outputs)

    def holds(x: Column, r: Column) -> Column:
        # Whoever has the whole number has its end too.
        return (x["own"] != r["number"]) & x["text"].contains(r["least"])

    return first_match(rows, other, holds, values, ["account_order"], outputs)


def _among_many(rows: DataFrame, other: DataFrame, values: dict[str, Column], outputs: dict[str, str]) -> DataFrame:
    """counterparty among any number of accounts.

    A number's last bytes, as many as the greatest power of two that it is long, meet the pieces of that length of the texts by
    their hashes; those pieces alone that a sketch of all such ends may hold, which Arrow batches are searched for. Of the numbers with one end that texts are searched for, the first two in order are kept, as a row passes over its own.
    """
    entry = F.struct("account_order", "number", *(c for c in outputs if c != "number"))
    known = other.filter("number is not null").groupBy("least", "number").agg(F.min(entry).alias("e"))
    ends = known.filter("least <> ''").groupBy("least").agg(F.slice(F.array_sort(F.collect_list("e")), F.lit(1), F.lit(2)).alias("first"))
    pieces = ends_within(other.filter("number is not null and least <> ''").select("least"))
    x = rows.withColumns({"_own": values["own"], "_text": values["text"]})
    asked = x.select("_own", "_text", F.explode(pieces(F.col("_text"))).alias("_end")).distinct()
    met = asked.join(ends.withColumn("_end", end_hash("least")), "_end").filter(F.col("_text").contains(F.col("least")))
    taken = F.when(F.col("first")[0]["number"] != F.col("_own"), F.col("first")[0]).otherwise(F.try_element_at("first", F.lit(2)))
    best = met.groupBy("_own", "_text").agg(F.min(taken).alias("_found"))
    # A number without a letter stands in every text.
    x = x.join(best, ["_own", "_text"], "left").withColumn("_blank", known.filter("least = ''").agg(F.min("e")).scalar())
    found = F.least(F.col("_found"), F.when(F.col("_own") != "", F.col("_blank")))
    kept = [c for c in rows.columns if c not in outputs.values()]
    return x.withColumn("_found", found).select(*kept, *(F.col(f"_found.{c}").alias(n) for c, n in outputs.items()))


def pair_key(a: Column, b: Column) -> Column:
    """One key for a pair in either order; null if either is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(F.least(a, b), F.lit("+"), F.greatest(a, b)))


# What a transfer between accounts of two stages is called.
STAGE_PAIRS = {"Free+Master": "Master to Free", "Master+RERA": "Master 2 RERA", "Free+IDW": "Free & IDW Loan", "IDW+RERA": "RERA 2 IDW"}


def pair_label(a: Column, b: Column, pairs: dict[str, str] | None = None) -> Column:
    out = F.lit(None).cast("string")
    for k, label in (STAGE_PAIRS if pairs is None else pairs).items():
        out = F.when(pair_key(a, b) == k, F.lit(label)).otherwise(out)
    return out


def account_by_tail(tails: DataFrame, accounts: DataFrame, digits: int = 4) -> DataFrame:
    """The first account that ends in the row's tail of so many digits; is_ambiguous where several companies have one. An equality join with one row a tail."""
    by_tail = accounts.groupBy(F.right("account_number", F.lit(digits)).alias("tail")).agg(F.min(F.struct("account_order", F.col("account_number").alias("a"), F.col("company").alias("c"))).alias("_f"), F.count_distinct("company").alias("_n"))
    return tails.join(by_tail, "tail", "left").select(*tails.columns, F.col("_f.a").alias("account_number"), F.col("_f.c").alias("company"), F.coalesce(F.col("_n") > 1, F.lit(False)).alias("is_ambiguous"))


def routed(rows: DataFrame, exact: DataFrame, active: DataFrame, exact_key: list[str], active_key: list[str], value: str, default: str | None) -> DataFrame:
    """The value under the exact key, else the one under the lesser key, else the default."""
    a = exact.select(*exact_key, F.col(value).alias("_exact"))
    b = active.select(*active_key, F.col(value).alias("_active"))
    return rows.join(a, exact_key, "left").join(b, active_key, "left").withColumn(value, F.coalesce("_exact", "_active", F.lit(default))).drop("_exact", "_active")


def table_name(override: Column, bank: Column, account: Column) -> Column:
    """An override, or the bank and the account's last four digits (0000 for a blank account)."""
    tail = F.coalesce(F.nullif(F.right(F.trim(account), F.lit(4)), F.lit("")), F.lit("0000"))
    return F.coalesce(override, F.concat(bank, F.lit(" - "), tail))


def first_known_segment(rows: DataFrame, column: str, dim: DataFrame, name: str, outputs: list[str], key: list[str], least: int = 3) -> DataFrame:
    """The first segment of at least so many characters that the dimension knows: segments explode, join and meet by the least position."""
    parts = rows.select(*key, F.posexplode(F.split(column, "[-/]", -1)).alias("_pos", "_part")).withColumn("_part", F.upper(F.trim("_part"))).filter(F.length("_part") >= least)
    known = dim.select(F.upper(F.trim(name)).alias("_part"), *(F.col(o).alias(f"_{o}") for o in outputs))
    found = parts.join(known, "_part").groupBy(*key).agg(F.min(F.struct("_pos", *(f"_{o}" for o in outputs))).alias("_f"))
    return rows.join(found, key, "left").select(*rows.columns, *(F.col(f"_f._{o}").alias(o) for o in outputs))


def range_bucket(rows: DataFrame, value: str, ranges: DataFrame, label: str, order: str) -> DataFrame:
    """start <= value < end, the first range wins; open ends are null, and a null value lies in no range."""
    inside = lambda x, r: (r["start"].isNull() | (r["start"] <= x["v"])) & (r["end"].isNull() | (x["v"] < r["end"]))
    return first_match(rows, ranges, inside, {"v": F.col(value)}, [order], [label])


def occurrence(df: DataFrame, key: list, order: list, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
