"""Predicates: keywords, series-key masks, dimension filters, ranges, boolean text queries, conjunctions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_words(text: Column, query: str) -> Column:
    """Every word of the query occurs somewhere; an empty query holds."""
    return reduce(lambda a, w: a & F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w)), query.lower().split(), F.lit(True))


def word_starts(text: Column, terms: list[str]) -> Column:
    """Every term occurs at the start of a word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, t: a & low.rlike("(?<![a-z0-9])" + re.escape(t.lower())), terms, F.lit(True))


def whole_words(text: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, w: a & low.rlike(r"(?<![a-z0-9_])" + re.escape(w.lower()) + r"(?![a-z0-9_])"), words, F.lit(True))


def id_or_name(code: Column, name: Column, words: list[str]) -> Column:
    """Any word is the id, or part of the name."""
    return reduce(lambda a, w: a | (F.lower(code) == w.lower()) | F.contains(F.lower(name), F.lit(w.lower())), words, F.lit(False))


def series_mask(dims: list[Column], mask: str) -> Column:
    """A dotted key: ``+`` joins alternatives, an empty part is any value, ``all`` or ``*`` is everything."""
    if mask.strip().lower() in ("", "all", "*"):
        return F.lit(True)
    parts = mask.split(".")
    if len(parts) > len(dims):
        raise ValueError(f"the key has {len(parts)} parts for {len(dims)} dimensions")
    return reduce(lambda a, x: a & x, [d.isin(*[v for v in p.split("+") if v]) for d, p in zip(dims, parts, strict=False) if p.strip("+")], F.lit(True))


def dimension_filter(columns: dict[str, Column], conditions: list[str]) -> Column:
    """``KEY=V1,V2`` conditions, all of them; keys in any case, unknown keys are an error."""
    known = {k.lower(): c for k, c in columns.items()}
    out = F.lit(True)
    for condition in conditions:
        key, _, values = condition.partition("=")
        if key.strip().lower() not in known:
            raise ValueError(f"no dimension {key}; there are {', '.join(columns)}")
        out = out & known[key.strip().lower()].isin(*[v.strip() for v in values.split(",") if v.strip()])
    return out


def multi_value(c: Column, values: str, sep: str = ";") -> Column:
    return c.isin(*[v.strip() for v in values.split(sep) if v.strip()])


def in_years(year: Column, start: int | None = None, end: int | None = None) -> Column:
    """A year range that keeps rows without a year."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (year >= start)
    if end is not None:
        inside = inside & (year <= end)
    return year.isNull() | inside


def has_data(flag: Column) -> Column:
    """Drops only what is known to have none."""
    return ~flag.eqNullSafe(F.lit(False))


def missing(c: Column) -> Column:
    """Spellings of no value: null, empty, NA and its like."""
    return c.isNull() | F.upper(F.trim(c.cast("string"))).isin("", "NA", "N/A", "NAN", "NULL", "-", ":", "..")


def lands_on(urls: Column, host: str) -> Column:
    return F.coalesce(F.exists(urls, lambda u: F.contains(u, F.lit(host))), F.lit(False))


def in_series(doi: Column, containers: Column, prefix: str | None = None, pattern: str | None = None, container: str | None = None) -> Column:
    tests = []
    if prefix:
        tests.append(F.startswith(doi, F.lit(prefix)))
    if pattern:
        tests.append(doi.rlike(pattern))
    if container:
        tests.append(F.array_contains(containers, container))
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def odata_filter(equal: dict[str, list[str]] | None = None, low: dict[str, object] | None = None, high: dict[str, object] | None = None) -> tuple[Column, str]:
    """A conjunction as a predicate and as the text that a service understands."""
    column, text = F.lit(True), []
    for k, values in (equal or {}).items():
        column = column & F.col(k).isin(*values)
        either = " or ".join("{} eq '{}'".format(k, str(v).replace("'", "''")) for v in values)
        text.append(f"({either})" if len(values) > 1 else either)
    for bounds, op in ((low, "ge"), (high, "le")):
        for k, v in (bounds or {}).items():
            column = column & (F.col(k) >= v if op == "ge" else F.col(k) <= v)
            text.append(f"{k} {op} {v}")
    return column, " and ".join(text)


def boolean_query(text: Column, query: str) -> Column:
    """Words are joined by AND, ``OR`` separates alternatives, quotation marks keep a phrase."""
    low = F.lower(F.coalesce(text, F.lit("")))
    alternatives = [[]]
    for phrase, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if word == "OR":
            alternatives.append([])
        elif word != "AND":
            alternatives[-1].append((phrase or word).lower())
    tests = [reduce(lambda a, t: a & F.contains(low, F.lit(t)), terms, F.lit(True)) for terms in alternatives if terms]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
