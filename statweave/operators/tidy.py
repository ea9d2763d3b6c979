"""Projections from nested records to tidy rows, and the small joins and filters that belong to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import nested
from ..functions.masks import missing
from ..functions.text import clean_text, looks_like_pdf, norm_doi


def observations(rows: DataFrame, countries: DataFrame | None = None, keep_empty: bool = False, economies_only: bool = False) -> DataFrame:
    """Indicator rows (indicator, country, countryiso3code, date, value) as (iso3, entity, indicator, period, value).

    An empty code falls back to the aggregate's code in ``countries`` (iso2, iso3, aggregate), else to the id given.
    """
    x = rows.select(F.col("indicator.id").alias("indicator"), F.col("country.id").alias("_id"), F.col("country.value").alias("entity"), F.nullif("countryiso3code", F.lit("")).alias("_iso3"), F.col("date").alias("period"), "value")
    if countries is not None:
        names = countries.select(F.col("iso2").alias("_id"), F.col("iso3").alias("_known"))
        x = x.join(names, "_id", "left").withColumn("_iso3", F.coalesce("_iso3", "_known")).drop("_known")
    x = x.withColumn("iso3", F.coalesce("_iso3", "_id"))
    if not keep_empty:
        x = x.where("value is not null")
    if economies_only and countries is not None:
        x = x.join(countries.where("not aggregate").select("iso3"), "iso3", "left_semi")
    return x.select("iso3", "entity", "indicator", "period", "value").orderBy("iso3", F.col("period").cast("string"))


def economies(rows: DataFrame) -> DataFrame:
    """Country records with region, income and lending structs as flat rows; aggregates are marked."""
    region = F.trim("region.value")
    return rows.select(F.col("id").alias("iso3"), F.col("iso2Code").alias("iso2"), F.trim("name").alias("name"), region.alias("region"), F.trim("incomeLevel.value").alias("income"), F.trim("lendingType.value").alias("lending"), F.nullif("capitalCity", F.lit("")).alias("capital"), (region == "Aggregates").alias("aggregate"))


def report_documents(docs: DataFrame) -> DataFrame:
    """Document records: title from its fallbacks, a chapter's longer name, the first of several DOIs."""
    short = F.coalesce(F.nullif("display_title", F.lit("")), F.nullif("repnme.repnme", F.lit("")), F.lit(""))
    long = F.coalesce(F.get(F.map_values("docna"), F.lit(0))["docna"], F.lit(""))
    title = F.when((F.length(long) > F.length(short)) & F.startswith(long, short), long).otherwise(short)
    doi = norm_doi(F.trim(F.split_part(F.coalesce("dois", F.lit("")), F.lit(";"), F.lit(1))))
    return docs.select("id", clean_text(title).alias("title"), doi.alias("doi"), F.col("docdt").alias("date"), F.col("docty").alias("type"), F.col("repnb").alias("report_no"), "guid", F.transform(F.map_values("authors"), lambda a: a["author"]).alias("authors"), "pdfurl", "url")


def repository_items(items: DataFrame) -> DataFrame:
    """Repository items: ``title: subtitle`` unless contained, type after a path mark, names of several authors."""
    m = F.col("metadata")
    title, sub = nested.first_metadata(m, "dc.title"), nested.first_metadata(m, "dc.title.subtitle", "okr.title.subtitle")
    full = F.when(sub.isNull() | F.contains(title, sub), title).otherwise(F.concat(title, F.lit(": "), sub))
    kind = F.coalesce(nested.first_metadata(m, "okr.doctype"), nested.first_metadata(m, "dc.type"))
    pdfs = F.filter(F.flatten(F.transform(F.filter("bundles", lambda b: b["name"] == "ORIGINAL"), lambda b: b["bitstreams"])), lambda f: F.lower(f["name"]).endswith(".pdf"))
    return items.select("uuid", "handle", full.alias("title"), F.element_at(F.split(kind, "::"), -1).alias("type"), norm_doi(nested.first_metadata(m, "dc.identifier.doi")).alias("doi"), nested.first_metadata(m, "dc.date.issued").alias("date"), nested.all_metadata(m, "dc.contributor.author").alias("authors"), pdfs.alias("pdfs"))


def projects(rows: DataFrame) -> DataFrame:
    """Project records: sectors as ``name (pct%)``, unique lists, the headline amount."""
    sector = F.transform("sectors", lambda s: F.concat(s["name"], F.when(s["percent"].isNotNull(), F.concat(F.lit(" ("), F.regexp_replace(F.format_string("%.6f", s["percent"].cast("double")), r"\.?0+$", ""), F.lit("%)"))).otherwise(F.lit(""))))
    return rows.select("id", "name", F.array_distinct(sector).alias("sectors"), F.array_distinct("themes").alias("themes"), nested.headline_amount(F.col("commitment"), F.col("current_amount"), F.col("grant_amount")).alias("amount"), "status")


def goal_observations(rows: DataFrame, dims: list[str], areas: DataFrame | None = None) -> DataFrame:
    """Goal records: the dimension map as columns, indicators and footnotes joined, areas resolved by number."""
    x = rows.select(F.array_join("indicator", ",").alias("indicator"), "series", "geoAreaCode", "geoAreaName", "timePeriodStart", "value", *[F.element_at("dimensions", F.lit(d)).alias(d) for d in dims], F.array_join(F.filter("footnotes", lambda f: f != ""), " | ").alias("footnotes"))
    if areas is None:
        return x
    return x.join(areas.select(F.col("m49").try_cast("int").alias("_m49"), "iso3"), F.col("geoAreaCode").try_cast("int") == F.col("_m49"), "left").drop("_m49")


def displacement_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Population rows: a dash is nothing, digits are numbers, columns in the order given."""
    return rows.select(*[F.when(F.col(c) == "-", "").otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.select(*columns).dtypes])


def numbers(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("bigint"))


def works(rows: DataFrame) -> DataFrame:
    """Index works: PDF link by preference, institutions once and twelve at most, abstract from its inverted index."""
    link = F.coalesce(F.col("best_oa_location.pdf_url"), F.col("primary_location.pdf_url"), F.get(F.filter("locations", lambda x: x["pdf_url"].isNotNull()), F.lit(0))["pdf_url"], F.when(looks_like_pdf(F.col("open_access.oa_url")), F.col("open_access.oa_url")))
    return rows.select("id", norm_doi(F.col("doi")).alias("doi"), clean_text(F.col("title")).alias("title"), F.col("publication_year").alias("year"), link.alias("pdf_url"), F.slice(F.array_distinct("institutions"), 1, 12).alias("institutions"), nested.inverted_to_text(F.col("abstract_inverted_index")).alias("abstract"), "cited_by_count")


def registered_works(rows: DataFrame) -> DataFrame:
    """Registry works: title with subtitle, names of authors, date from its parts, the venue chain."""
    from ..functions.periods import date_parts

    title = F.concat_ws(": ", F.get("title", F.lit(0)), F.get("subtitle", F.lit(0)))
    return rows.select(norm_doi(F.col("DOI")).alias("doi"), clean_text(title).alias("title"), F.transform("author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))).alias("authors"), date_parts(F.get("issued", F.lit(0))).alias("date"), F.coalesce(F.get("container", F.lit(0)), F.col("institution"), F.col("publisher")).alias("venue"))


def series_rows(rows: DataFrame, order: list[str], country: list[str], frequency: list[str]) -> DataFrame:
    """Observations with a dimension map: key, place, frequency, the other dimensions as the indicator, unit, status."""
    d = F.col("dims")
    place = F.coalesce(*[F.element_at(d, F.lit(k)) for k in country])
    freq = F.coalesce(*[F.element_at(d, F.lit(k)) for k in frequency])
    rest = [k for k in order if k not in country and k not in frequency]
    return rows.select(nested.series_key(d, order).alias("series_key"), place.alias("entity"), freq.alias("frequency"), F.array_join(F.array_compact(F.array(*[F.element_at(d, F.lit(k)) for k in rest])), ".").alias("indicator"), "period", "value", F.coalesce(F.element_at(d, F.lit("UNIT")), F.element_at("attrs", F.lit("UNIT"))).alias("unit"), F.coalesce(F.element_at("attrs", F.lit("DERIVATION_TYPE")), F.element_at("attrs", F.lit("OBS_STATUS"))).alias("status"))


def records(rows: DataFrame, prefix: str, key: str, notes: list[Column], **fields: Column) -> DataFrame:
    """Source records for a log: id ``prefix:key`` and joined notes."""
    return rows.select(F.concat(F.lit(f"{prefix}:"), F.col(key)).alias("id"), F.concat_ws("; ", *notes).alias("notes"), *[c.alias(n) for n, c in fields.items()])


def drop_missing(df: DataFrame, value: str, counts: Observation | None = None) -> DataFrame:
    """Rows with a value; the observation gets how many were read and dropped, without another scan."""
    gone = missing(F.col(value))
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(gone).alias("dropped"))
    return df.where(~gone)


def only_totals(df: DataFrame, totals: dict[str, list[str]]) -> DataFrame:
    """Rows that are totals in every dimension in which some row is one; other dimensions don't matter.

    Which dimensions have totals is one row of flags, joined to the data as a broadcast of that row.
    """
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(d).isin(*codes)), F.lit(False)).alias(f"_has_{d}") for d, codes in totals.items()])
    keep = reduce(lambda a, b: a & b, [~F.col(f"_has_{d}") | F.coalesce(F.col(d).isin(*codes), F.lit(False)) for d, codes in totals.items()], F.lit(True))
    return df.join(F.broadcast(flags), how="cross").where(keep).select(*df.columns)


def compact_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns with several values, and the single value of each other one."""
    row = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"n_{c}") for c in df.columns], *[F.first(F.col(c).cast("string"), ignorenulls=True).alias(f"v_{c}") for c in df.columns]).first()
    varying = [c for c in df.columns if row[f"n_{c}"] > 1]
    return df.select(*varying), {c: row[f"v_{c}"] for c in df.columns if c not in varying}


def facet_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """(dimension, code, n) of all dimensions in one pass."""
    sets = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("code")) for d in dims]
    return df.select(F.explode(F.array(*sets)).alias("x")).groupBy("x.dimension", "x.code").agg(F.count("*").alias("n"))


def facets_with_filters(df: DataFrame, dims: list[str], filters: dict[str, list[str]]) -> DataFrame:
    """Facets in which a dimension's counts respect the filters on the other dimensions, in one pass."""
    cells = []
    for d in dims:
        others = reduce(lambda a, b: a & b, [F.col(k).isin(*v) for k, v in filters.items() if k != d], F.lit(True))
        cells.append(F.when(others, F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("code"))))
    return df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).groupBy("x.dimension", "x.code").agg(F.count("*").alias("n"))


def page_statistics(pages: DataFrame) -> DataFrame:
    """Per document: pages, characters, words, empty pages and whether it looks scanned."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    per = pages.select("doc_id", "page", F.length(body).alias("chars"), F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+"))).alias("words"))
    empty = F.col("chars") < 20
    return per.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.count_if(empty).alias("empty_pages"), (F.count_if(empty) * 2 > F.count("*")).alias("likely_scanned"))


def letter_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.length(c)).otherwise(F.lit(0.0))


def series_summary(df: DataFrame, series: list[str], period: str, value: str) -> DataFrame:
    """Per series: observations, first and last period, last period with a value."""
    has = F.col(value).isNotNull()
    return df.groupBy(*series).agg(F.count("*").alias("n"), F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.max(F.when(has, F.col(period))).alias("last_available"))


def sort_as_text(df: DataFrame, columns: list[str], null: str = "") -> DataFrame:
    """Rows in the order of their values as text, nulls as a given text."""
    return df.orderBy(*[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns])


def catalogue_order(df: DataFrame, name_match: Column, main_source: Column, name: str, code: str) -> DataFrame:
    """Matches in the name first, then the main source, then short names, then code."""
    return df.orderBy(name_match.desc(), main_source.desc(), F.length(name), F.col(code))


def dotted_order(df: DataFrame, code: str, name: str) -> DataFrame:
    """Codes with few dots first, then short names."""
    return df.orderBy(F.length(F.regexp_replace(code, r"[^.]", "")), F.length(name), F.col(code))
