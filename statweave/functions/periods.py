"""Dates, periods, versions and amounts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(c: Column) -> Column:
    """The leading YYYY[-MM[-DD]] of a text; null if the year is outside 1800 to 2100."""
    d = F.regexp_extract(c, r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)", 1)
    return F.when(F.left(d, F.lit(4)).try_cast("int").between(1800, 2100), d)


def iso_year(c: Column) -> Column:
    return F.left(iso_date(c), F.lit(4)).try_cast("int")


def year_in_text(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(1[5-9]\d\d|20\d\d)\b", 1).try_cast("int")


def year_or_none(c: Column) -> Column:
    return F.left(c, F.lit(4)).try_cast("int")


def date_bound(c: Column, end: bool = False) -> Column:
    """First or real last day of YYYY, YYYY-MM or YYYY-MM-DD; null otherwise."""
    first = F.try_to_date(F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), "yyyy-MM-dd")
    if not end:
        return first
    return F.when(F.length(c) == 4, F.last_day(F.add_months(first, 11))).when(F.length(c) == 7, F.last_day(first)).otherwise(first)


def period_bound(c: Column, end: bool = False) -> Column:
    """Bound of YYYY, YYYY-Qn, YYYY-MM or a day as text; upper bounds use day 31, for comparison only."""
    quarter = F.regexp_extract(c, r"^\d{4}-?Q([1-4])$", 1).try_cast("int")
    year = F.left(c, F.lit(4))
    month = F.lpad((quarter * 3 - (0 if end else 2)).cast("string"), 2, "0")
    day = "31" if end else "01"
    return (
        F.when(quarter.isNotNull(), F.concat(year, F.lit("-"), month, F.lit(f"-{day}")))
        .when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-12-31" if end else "-01-01")))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit(f"-{day}")))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)
    )


def iso_month(c: Column) -> Column:
    """``January 2011`` as ``2011-01``."""
    return F.date_format(F.to_date(F.try_to_timestamp(c, F.lit("MMMM yyyy"))), "yyyy-MM")


def date_parts(parts: Column) -> Column:
    """``[2021, 3]`` as ``2021-03``."""
    return F.concat_ws("-", F.get(parts, F.lit(0)).cast("string"), F.lpad(F.get(parts, F.lit(1)).cast("string"), 2, "0"), F.lpad(F.get(parts, F.lit(2)).cast("string"), 2, "0"))


def period_tag(start: Column, end: Column, last: Column | None = None) -> Column:
    """A file name's part: 2015-2024, from2015, to2020 or last5."""
    last = F.lit(None).cast("string") if last is None else last.cast("string")
    return (
        F.when(start.isNotNull() & end.isNotNull(), F.when(start == end, start).otherwise(F.concat(start, F.lit("-"), end)))
        .when(start.isNotNull(), F.concat(F.lit("from"), start))
        .when(end.isNotNull(), F.concat(F.lit("to"), end))
        .when(last.isNotNull(), F.concat(F.lit("last"), last))
    )


def last_day_of(exclusive_end: Column) -> Column:
    return F.date_sub(F.try_to_date(F.left(exclusive_end, F.lit(10)), "yyyy-MM-dd"), 1)


def age_days(fetched: Column) -> Column:
    return F.datediff(F.current_date(), fetched)


def amount(c: Column) -> Column:
    """A number's whole part; thousands marks and bad text give null."""
    return c.cast("string").try_cast("double").try_cast("bigint")


def version_key(c: Column) -> Column:
    """Dotted version as an array of numbers, -1 for parts that aren't; arrays compare like tuples."""
    return F.transform(F.split(c, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(-1)))


def period_range(c: Column, fallback: Column | None = None) -> Column:
    """Aggregate: ``min:max`` of the non-empty values, one value as itself, else the fallback."""
    v = F.nullif(c, F.lit(""))
    low, high = F.min(v), F.max(v)
    return F.coalesce(F.when(low == high, low).otherwise(F.concat(low, F.lit(":"), high)), F.lit(None).cast("string") if fallback is None else fallback)
