"""Order-dependent operators: dedup, releases, versions, latest values, candidates, ranks. Order is an explicit column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import version_key


def keep_first(df: DataFrame, key: list[str], seq: Column) -> DataFrame:
    """The first row of each key in the order of ``seq``."""
    w = Window.partitionBy(*key).orderBy(seq)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each id, with the place at which the id was first seen."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, seq).alias("_row"), F.min(seq).alias("first_seen")).select(key, "_row.*", "first_seen")


def rank(df: DataFrame, *order: Column, name: str = "rank", by: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rank(df, *order, name="_place", by=by).where(F.col("_place") <= n).drop("_place")


def latest_for_request(df: DataFrame, period: str, value: str, n: int) -> DataFrame:
    """Rows of the latest n periods that have any value; an entity's own value may be missing there."""
    periods = df.where(F.col(value).isNotNull()).select(period).distinct().orderBy(F.col(period).desc()).limit(n)
    return df.join(F.broadcast(periods), period, "left_semi")  # n rows


def latest_nonempty(df: DataFrame, entity: list[str], period: str, value: str, n: int) -> DataFrame:
    """The latest n values of each entity, missing ones not counted."""
    return top_per_group(df.where(F.col(value).isNotNull()), entity, [F.col(period).desc()], n)


def last_observations(df: DataFrame, series: list[str], period: str, n: int) -> DataFrame:
    """The last n observations of each series, placeholders counted."""
    return top_per_group(df, series, [F.col(period).desc()], n)


def newest_version(df: DataFrame, key: list[str], version: str, seq: str) -> DataFrame:
    """The row with the highest dotted version of each key; equal versions keep the first."""
    w = Window.partitionBy(*key).orderBy(version_key(F.col(version)).desc(), F.col(seq))
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def collapse_releases(df: DataFrame, provider: str = "provider", code: str = "code", indexed_at: str = "indexed_at", seq: str = "seq") -> DataFrame:
    """One row for each family of dataset releases, with the number hidden.

    A family is the provider and the code before a colon, case ignored. A release replaces what is held when its code
    sorts after it; a plain code replaces when it was indexed later. Families of one kind are a maximum; only families
    that mix both kinds depend on the order and are folded row by row, a family at a time.
    """
    family = F.upper(F.split_part(F.col(code), F.lit(":"), F.lit(1)))
    rows = df.withColumn("_family", family).withColumn("_release", F.contains(F.col(code), F.lit(":")))
    w = Window.partitionBy(provider, "_family")
    rows = rows.withColumn("_kinds", F.size(F.collect_set("_release").over(w))).withColumn("hidden", F.count("*").over(w) - 1).withColumn("first_seen", F.min(seq).over(w))
    best = Window.partitionBy(provider, "_family").orderBy(F.when(F.col("_release"), F.col(code)).desc_nulls_last(), F.when(~F.col("_release"), F.col(indexed_at)).desc_nulls_last(), F.col(seq))
    pure = rows.where("_kinds = 1").withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")
    mixed = rows.where("_kinds = 2")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        held = None
        for row in frame.sort_values(seq).itertuples(index=True):
            now = frame.loc[row.Index]
            if held is None or (now[code] > held[code] if now["_release"] else str(now[indexed_at] or "") > str(held[indexed_at] or "")):
                held = now
        return held.to_frame().T.astype(frame.dtypes.to_dict())

    folded = mixed.groupBy(provider, "_family").applyInPandas(fold, rows.schema)
    return pure.unionByName(folded).drop("_family", "_release", "_kinds")


#: Preference among versions of a paper.
VERSION_ORDER = ("publishedVersion", "acceptedVersion", "submittedVersion")


def choose_candidate(df: DataFrame, item: str, url: str, source_rank: str, version: str, passed: str, seq: str) -> DataFrame:
    """The first link of each item that passed its check: best source, then version, then order; each link once."""
    once = keep_first(df, [item, url], F.col(seq))
    order = F.coalesce(*[F.when(F.col(version) == v, F.lit(i)) for i, v in enumerate(VERSION_ORDER)], F.lit(len(VERSION_ORDER)))
    return top_per_group(once.where(passed), [item], [F.col(source_rank), order, F.col(seq)], 1)


def best_pdf(df: DataFrame, item: str, name: str, sequence: str) -> DataFrame:
    """A full report before others before summaries, then the item's own sequence, null last."""
    low = F.lower(F.col(name))
    kind = F.when(low.rlike("summary|overview"), 2).when(low.rlike("full|report|main"), 0).otherwise(1)
    return top_per_group(df, [item], [kind, F.col(sequence).asc_nulls_last(), F.col(name)], 1)


def spread_hits(hits: DataFrame, doc: str, page: str, place: str, k: int) -> DataFrame:
    """k hits spread over the pages: first ones of all pages before second ones."""
    nth = rank(hits, F.col(place), name="nth", by=[doc, page])
    return top_per_group(nth, [doc], [F.col("nth"), F.col(page)], k)


def latest_actual(df: DataFrame, key: list[str], period: str, actual: Column) -> DataFrame:
    """(key, latest_actual) of the keys with an actual value: the last period that isn't a projection."""
    return df.where(actual).groupBy(*key).agg(F.max(period).alias("latest_actual"))


def vintage(df: DataFrame, agency: str, agencies: list[str], released: str) -> DataFrame:
    """The rows of each wanted agency's newest vintage."""
    wanted = df.where(F.col(agency).isin(*agencies))
    newest = wanted.groupBy(agency).agg(F.max(released).alias(released))
    return wanted.join(newest, [agency, released], "left_semi").select(*df.columns)
