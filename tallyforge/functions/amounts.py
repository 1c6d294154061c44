"""Amounts as decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
AMOUNT = r"^-?[\d,]+\.\d{2}$"


def parsed_amount(c: Column) -> Column:
    """Text such as 1,20,000.00; blank or bad text is 0."""
    return F.coalesce(F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast(MONEY), F.lit(0).cast(MONEY))


def strict_amount(c: Column) -> Column:
    """Only text that is an amount as statements print it; else null."""
    return F.when(c.rlike(AMOUNT), F.replace(c, F.lit(","), F.lit("")).try_cast(MONEY))


def number_or_null(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")


def amount_of(credits: Column, debits: Column) -> Column:
    return F.when(credits > 0, credits).otherwise(debits)


def rounded(c: Column) -> Column:
    """Half up, on decimals."""
    return F.round(c.cast("decimal(20,4)"), 2)


def formatted(c: Column) -> Column:
    return F.format_number(c, 2)


def direction(credits: Column, debits: Column) -> Column:
    return F.when(credits > 0, F.lit("credit")).when(debits > 0, F.lit("debit")).otherwise(F.lit("unknown"))


def direction_allows(rule: Column, found: Column) -> Column:
    """A rule for either direction, or a row of unknown direction, is never excluded."""
    return rule.isNull() | (rule == "both") | (found == "unknown") | (rule == found)
