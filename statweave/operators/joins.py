"""Resolution joins: countries, code lists, availability, conditional attributes, log records, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from .ranking import last_wins


def resolve_countries(tokens: DataFrame, token: str, countries: DataFrame, out: str = "iso3") -> DataFrame:
    """A token's country: by ISO code (any case), then number as a number, then exact name; else the token itself.

    ``countries`` has iso3, iso2, m49, name and seq; its rows become keys with priorities, one equi-join does the rest.
    """
    keys = countries.select(
        "iso3",
        "seq",
        F.explode(
            F.array(
                F.struct(F.upper("iso3").alias("key"), F.lit(1).alias("priority")),
                F.struct(F.upper("iso2").alias("key"), F.lit(1).alias("priority")),
                F.struct(F.concat(F.lit("#"), F.col("m49").try_cast("int").cast("string")).alias("key"), F.lit(2).alias("priority")),
                F.struct(F.concat(F.lit("="), F.lower(F.trim("name"))).alias("key"), F.lit(3).alias("priority")),
            )
        ).alias("k"),
    ).where("k.key is not null")
    keys = keys.groupBy(F.col("k.key").alias("_key"), F.col("k.priority").alias("_priority")).agg(F.min_by("iso3", "seq").alias("_iso3"))
    t = F.trim(F.col(token))
    distinct = tokens.select(token).distinct()
    tried = distinct.select(token, F.explode(F.array_compact(F.array(F.upper(t), F.concat(F.lit("#"), t.try_cast("int").cast("string")), F.concat(F.lit("="), F.lower(t))))).alias("_key"))
    found = tried.join(keys, "_key").groupBy(token).agg(F.min_by("_iso3", "_priority").alias("_iso3"))
    return tokens.join(found, token, "left").withColumn(out, F.coalesce("_iso3", t)).drop("_iso3")


def codes_with_availability(codes: DataFrame, available: DataFrame, key: list[str], append: bool = True) -> DataFrame:
    """Codes with whether they have data; codes with data that the list lacks are appended if asked for."""
    a = codes.withColumn("_listed", F.lit(True))
    b = available.select(*key).distinct().withColumn("_data", F.lit(True))
    return a.join(b, key, "full_outer" if append else "left").withColumn("listed", F.coalesce("_listed", F.lit(False))).withColumn("has_data", F.coalesce("_data", F.lit(False))).drop("_listed", "_data")


def in_use(codes: DataFrame, available: DataFrame, key: list[str]) -> DataFrame:
    """The codes with data; all codes if none has any."""
    marked = codes_with_availability(codes, available, key, append=False)
    some = marked.agg(F.coalesce(F.bool_or("has_data"), F.lit(False)).alias("_some"))
    return marked.join(F.broadcast(some), how="cross").where("has_data or not _some").drop("_some", "listed")


def with_fallback(left: DataFrame, right: DataFrame, keys: list[list[str]], value: str) -> DataFrame:
    """A value by the longest key that has one: (agency, id, version), then (agency, id), then id."""
    out = left
    for i, key in enumerate(keys):
        level = right.groupBy(*key).agg(F.first(value, ignorenulls=True).alias(f"_v{i}"))
        out = out.join(level, key, "left")
    return out.withColumn(value, F.coalesce(*[f"_v{i}" for i in range(len(keys))])).drop(*[f"_v{i}" for i in range(len(keys))])


def group_attributes(series: DataFrame, groups: DataFrame, series_id: str, own: str = "attrs") -> DataFrame:
    """Attributes of the groups whose dimensions all equal the series'; later groups override, the series' own last.

    ``groups`` has keys (map), attrs (map) and seq; a group without keys never applies. Group definitions are metadata
    of one dataset: one join for each set of key names, each an equi-join on those dimensions.
    """
    named = groups.where("cardinality(keys) > 0").withColumn("_names", F.array_sort(F.map_keys("keys")))
    shapes = [r["_names"] for r in named.select("_names").distinct().collect()]  # sets of dimension names in one structure
    met = None
    for names in shapes:
        g = named.where(F.col("_names") == F.array(*[F.lit(n) for n in names])).select(*[F.element_at("keys", F.lit(n)).alias(f"_k{i}") for i, n in enumerate(names)], F.col("attrs").alias("_attrs"), "seq")
        s = series.select(series_id, *[F.element_at("dims", F.lit(n)).alias(f"_k{i}") for i, n in enumerate(names)])
        one = s.join(g, [f"_k{i}" for i in range(len(names))]).select(series_id, "_attrs", "seq")
        met = one if met is None else met.unionByName(one)
    if met is None:
        return series
    pairs = met.select(series_id, "seq", F.explode("_attrs").alias("k", "v")).groupBy(series_id, "k").agg(F.max_by("v", "seq").alias("v"))
    merged = pairs.groupBy(series_id).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_group"))
    out = series.join(merged, series_id, "left")
    empty = F.create_map().cast("map<string,string>")
    return out.withColumn(own, override(F.coalesce("_group", empty), F.coalesce(own, empty))).drop("_group")


def override(base: Column, over: Column) -> Column:
    """A map with another's entries taking precedence."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def label(df: DataFrame, labels: DataFrame, key: str, name: str, default: str = "") -> DataFrame:
    return df.join(labels.select(key, name), key, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def missing_entities(requested: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return requested.join(found, key, "left_anti").select(key).distinct()


def claim_folders(claims: DataFrame, folders: DataFrame, default: str | None = None) -> DataFrame:
    """The text folder of each claim: its own, else the first with its source, else the default; null is no text."""
    first = folders.groupBy("source_id").agg(F.min("folder").alias("_by_source"))
    own = F.nullif(F.col("text"), F.lit(""))
    return claims.join(first, "source_id", "left").withColumn("folder", F.coalesce(own, "_by_source", F.lit(default).cast("string"))).drop("_by_source")


def logged_source(docs: DataFrame, log: DataFrame) -> DataFrame:
    """The record of each document: by id, else by URL, the record whose id was first seen last.

    ``log`` has id, url, pdf_url and seq; later lines of an id replace earlier ones.
    """
    latest = last_wins(log, "id", "seq")
    by_id = latest.select(F.col("id").alias("source_id"), F.col("id").alias("_by_id"))
    urls = latest.select("id", "first_seen", F.explode(F.array("pdf_url", "url")).alias("u")).where("u is not null and u != ''")
    by_url = urls.groupBy(canonical_url(F.col("u")).alias("_canon")).agg(F.max_by("id", "first_seen").alias("_by_url"))
    out = docs.join(by_id, "source_id", "left").withColumn("_canon", canonical_url(F.col("url"))).join(by_url, "_canon", "left")
    return out.withColumn("record_id", F.coalesce("_by_id", "_by_url")).drop("_by_id", "_by_url", "_canon")


def neighbours(edges: DataFrame, works: DataFrame, key: str = "id") -> DataFrame:
    """One hop of citations or references; edges without an id at either end don't count."""
    return edges.where("source is not null and target is not null").join(works, F.col("target") == F.col(key))


def compare_releases(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Two sources or vintages side by side, with the difference."""
    return a.select(*keys, F.col(value).alias("a_value")).join(b.select(*keys, F.col(value).alias("b_value")), keys, "full_outer").withColumn("difference", F.col("b_value") - F.col("a_value"))


def current_entry(entries: DataFrame, code: str, name: str, key: str, iso: str, label_: str) -> DataFrame:
    """Reporter entries not expired that match an ISO code; by name only where no code matches."""
    hit = entries.where("not expired").withColumn("_p", F.when(F.upper(iso) == key.upper(), 1).when(F.lower(label_) == name.lower(), 2)).where("_p is not null")
    best = Window.partitionBy().orderBy("_p", code)
    return hit.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_p")


def series_of_datasets(series: DataFrame, text_match: Column, datasets: int = 5, each: int = 10) -> DataFrame:
    """Two-step search: the datasets with the most matching series, then the first series of each."""
    hits = series.where(text_match)
    top = hits.groupBy("dataset").agg(F.count("*").alias("matches")).orderBy(F.col("matches").desc(), "dataset").limit(datasets)
    return hits.join(F.broadcast(top), "dataset").withColumn("_n", F.row_number().over(Window.partitionBy("dataset").orderBy("series"))).where(F.col("_n") <= each).drop("_n")


def union_of_codes(a: DataFrame, b: DataFrame, key: str, left: str, right: str, out: str) -> DataFrame:
    """The codes that either of two constraints allows for a key."""
    none = F.array().cast("array<string>")
    return a.join(b, key, "full_outer").select(key, F.array_union(F.coalesce(left, none), F.coalesce(right, none)).alias(out))
