"""Dates, fiscal quarters and fiscal years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layouts that statements use; ISO first and exactly, all others with the day first.
LAYOUTS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "d/M/yyyy", "d-M-yyyy", "dd-MMM-yy", "d-MMM-yyyy", "d-MMM-yy", "dd MMM yyyy", "dd.MM.yyyy", "dd/MM/yy")
# Dates within a line of text, tried in this order.
DATE_PATTERNS = (r"\d{1,2}-[A-Za-z]{3}-\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}")


def parsed_date(c: Column) -> Column:
    """The day that the text names; null for bad text."""
    t = F.trim(c)
    lettered = t.rlike("[A-Za-z]")

    def tried(layout: str) -> Column:
        # A layout that fails costs an exception, so those whose separator or month the text does not have are passed over.
        separator = layout.strip("dMy")[0]
        fits = t.contains(F.lit(separator)) & (lettered if "MMM" in layout else ~lettered)
        return F.when(fits, F.try_to_timestamp(t, F.lit(layout)).cast("date"))

    return F.coalesce(*map(tried, LAYOUTS))


def canonical_date(c: Column) -> Column:
    """The day as ISO text; text that names none stays as it is, trimmed, so that it equals nothing but itself; null becomes empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(parsed_date(t).cast("string"), t)


def date_in(c: Column) -> Column:
    """The first pattern's match within the text, or null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(c, p, 0), F.lit("")) for p in DATE_PATTERNS))


def fiscal_quarter(d: Column, first_month: int = 4) -> Column:
    return F.concat(F.lit("Q"), (F.floor(F.pmod(F.month(d) - first_month, F.lit(12)) / 3) + 1).cast("string"))


def fiscal_year_start(d: Column, first_month: int = 4) -> Column:
    return F.year(d) - F.when(F.month(d) < first_month, 1).otherwise(0)


def fiscal_year(d: Column, first_month: int = 4) -> Column:
    """The label of the year that a day lies in, such as 2026-27."""
    y = fiscal_year_start(d, first_month)
    return F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0"))


def fiscal_range(label: Column, first_month: int = 4) -> Column:
    """A struct (first, last) of days; null where the label's two parts are not successive years."""
    y = F.regexp_extract(label, r"^(\d{4})-(\d{2})$", 1).try_cast("int")
    z = F.regexp_extract(label, r"^(\d{4})-(\d{2})$", 2).try_cast("int")
    first = F.make_date(y, F.lit(first_month), F.lit(1))
    return F.when(F.pmod(y + 1, F.lit(100)) == z, F.struct(first.alias("first"), F.date_sub(F.add_months(first, 12), 1).alias("last")))


def fiscal_year_options(first_year: int | Column, count: int | Column) -> Column:
    """The labels of so many fiscal years from the first one on."""
    first, n = (F.lit(x) if isinstance(x, int) else x for x in (first_year, count))
    years = F.sequence(first, first + n - 1)
    return F.transform(years, lambda y: F.concat(y.cast("string"), F.lit("-"), F.lpad(F.pmod(y + 1, F.lit(100)).cast("string"), 2, "0")))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def shown_time(ts: Column, minutes: int = 330) -> Column:
    """A UTC time as it is shown, so many minutes ahead."""
    return F.date_format(ts + F.make_dt_interval(mins=F.lit(minutes)), "dd MMM yyyy, hh:mm a")
