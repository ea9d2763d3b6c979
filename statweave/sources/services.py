"""Scans of public statistical and bibliographic services, as DataFrames over the ``paged_json`` source.

Each function takes the arguments of a search and ``io`` (options of the source: ``mode``, ``folder``, ``pause``, …),
asks for as little as the service allows, and gives tidy rows. With ``mode="recorded"`` pages come from a folder.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, nested, periods
from ..functions.text import clean_text, looks_like_pdf, norm_doi
from ..operators import fusion, ranking, tidy
from . import payloads
from .connector import register


class Service(NamedTuple):
    base: str
    paging: str = "none"
    size: int = 100
    at: dict[str, str] = {}


#: Names of the paging parameters, and where a reply has its total and its rows.
OS_ROWS = {"page": "os", "size": "rows", "total": "total"}
SEARCH_PAGES = {"page": "page", "size": "size", "total": "_embedded.searchResult.page.totalPages", "rows": "_embedded.searchResult._embedded.objects", "served": "_embedded.searchResult.page.size"}
#: Addresses of the services and how they page.
SERVICES = {
    "indicators": Service("https://api.worldbank.org/v2", "page", 1000),
    "reports": Service("https://search.worldbank.org/api/v3", "rows", 50, OS_ROWS | {"rows": "documents"}),
    "repository": Service("https://openknowledge.worldbank.org/server/api", "pages", 20, SEARCH_PAGES),
    "projects": Service("https://search.worldbank.org/api/v2", "rows", 50, OS_ROWS | {"rows": "projects"}),
    "series": Service("https://api.db.nomics.world/v22", "offset", 1000, {"total": "series.num_found"}),
    "cubes": Service("https://ec.europa.eu/eurostat/api/dissemination"),
    "goals": Service("https://unstats.un.org/SDGAPI/v1/sdg", "page", 1000, {"size": "pageSize"}),
    "charts": Service("https://ourworldindata.org/grapher"),
    "education": Service("https://api.uis.unesco.org/api/public"),
    "health": Service("https://ghoapi.azureedge.net/api", "next"),
    "displacement": Service("https://api.unhcr.org/population/v1", "page", 1000, {"size": "limit"}),
    "trade": Service("https://comtradeapi.un.org/public/v1/preview"),
    "openalex": Service("https://api.openalex.org", "page", 100, {"size": "per-page", "total": "meta.count"}),
    "crossref": Service("https://api.crossref.org", "offset", 100, {"size": "rows", "total": "message.total-results"}),
    "semantic": Service("https://api.semanticscholar.org/graph/v1", "offset", 100),
    "arxiv": Service("https://export.arxiv.org/api"),
    "core": Service("https://api.core.ac.uk/v3", "offset", 100, {"total": "totalHits"}),
    "nber": Service("https://www.nber.org/api/v1/working_page_listing/contentType/working_paper/_/_", "page", 100, {"size": "perPage", "total": "totalResults"}),
    "unpaywall": Service("https://api.unpaywall.org/v2"),
}
#: Addresses of SDMX providers.
SDMX = {
    "ecb": "https://data-api.ecb.europa.eu/service",
    "imf": "https://api.imf.org/external/sdmx/2.1",
    "oecd": "https://sdmx.oecd.org/public/rest",
    "ilo": "https://sdmx.ilo.org/rest",
    "unicef": "https://sdmx.data.unicef.org/ws/public/sdmxapi/rest",
    "un": "https://data.un.org/ws/rest",
}
PREVIEW_ROWS = 500


def scan(spark: SparkSession, service: str | Service, path: str | list[str], params: dict | None = None, **io: str) -> DataFrame:
    """Pages (url, path, page, body) of one path or several."""
    register(spark)
    s = SERVICES[service] if isinstance(service, str) else service
    options = {"base": s.base, "paging": s.paging, "pagesize": str(s.size), "at": json.dumps(s.at), "path": path if isinstance(path, str) else "|".join(path), "params": json.dumps(params or {})}
    return spark.read.format("paged_json").options(**options | {k: str(v) for k, v in io.items()}).load()


def _rows(pages: DataFrame, at: str, ddl: str) -> DataFrame:
    """The array at a JSON path of each page as rows."""
    return pages.select(F.explode(F.from_json(F.get_json_object("body", at), f"array<{ddl}>")).alias("r")).select("r.*")


# Indicators -------------------------------------------------------------------------------------------------------

INDICATOR_ROW = "struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:double,unit:string,obs_status:string,decimal:int>"
COUNTRY_ROW = "struct<id:string,iso2Code:string,name:string,region:struct<id:string,value:string>,incomeLevel:struct<id:string,value:string>,lendingType:struct<id:string,value:string>,capitalCity:string>"
CATALOGUE_ROW = "struct<id:string,name:string,unit:string,source:struct<id:string,value:string>,sourceNote:string,sourceOrganization:string,topics:array<struct<id:string,value:string>>>"


def indicator_values(spark, indicators: list[str], countries: list[str] | None = None, date: str | None = None, mrv: int | None = None, mrnev: int | None = None, source: str | None = None, frequency: str | None = None, keep_empty: bool = False, economies_only: bool = False, country_table: DataFrame | None = None, **io) -> DataFrame:
    """Observations of indicators; one of ``date``, ``mrv`` and ``mrnev`` may be given."""
    if sum(x is not None for x in (date, mrv, mrnev)) > 1:
        raise ValueError("give one of date, mrv and mrnev")
    where = ";".join(countries or ["all"])
    params = {"format": "json", "date": date, "mrv": mrv, "mrnev": mrnev, "source": source, "frequency": frequency}
    pages = scan(spark, "indicators", [f"country/{where}/indicator/{i}" for i in indicators], params, **io)
    return tidy.observations(payloads.envelope(pages, INDICATOR_ROW), country_table, keep_empty, economies_only)


def economies(spark, names: list[str] | None = None, region: str | None = None, income: str | None = None, lending: str | None = None, aggregates: bool = False, everything: bool = False, **io) -> DataFrame:
    """The country table; economies unless aggregates or everything are asked for."""
    x = tidy.economies(payloads.envelope(scan(spark, "indicators", "country", {"format": "json"}, **io), COUNTRY_ROW))
    if not everything:
        x = x.where("aggregate" if aggregates else "not aggregate")
    for column, value in (("region", region), ("income", income), ("lending", lending)):
        if value:
            x = x.where(F.contains(F.lower(column), F.lit(value.lower())))
    return x.where(masks.id_or_name(F.col("iso3"), F.col("name"), names)) if names else x


def find_indicators(spark, keywords: list[str], source: str | None = None, topic: str | None = None, name_only: bool = False, limit: int = 50, **io) -> DataFrame:
    """Catalogue search by word starts, best names first."""
    x = payloads.envelope(scan(spark, "indicators", f"sources/{source}/indicators" if source else "indicator", {"format": "json"}, **io), CATALOGUE_ROW)
    in_name = masks.word_starts(F.concat_ws(" ", "id", "name"), keywords)
    hit = in_name if name_only else masks.word_starts(F.concat_ws(" ", "id", "name", "sourceNote"), keywords)
    x = x.where(hit)
    if topic:
        x = x.where(F.exists("topics", lambda t: F.contains(F.lower(t["value"]), F.lit(topic.lower()))))
    marked = x.select("id", "name", F.col("source.id").alias("source"), in_name.alias("in_name"), F.coalesce(F.col("source.id") == "2", F.lit(False)).alias("main"))
    return tidy.catalogue_order(marked, F.col("in_name"), F.col("main"), "name", "id").limit(limit).drop("main")


def indicator_source(values: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Values with their catalogue source, the main one where it isn't known."""
    known = catalogue.select(F.col("id").alias("indicator"), F.col("source.id").alias("source"))
    return values.join(known, "indicator", "left").withColumn("source", F.coalesce("source", F.lit("2")))


# Reports, repository, projects ------------------------------------------------------------------------------------

REPORT_ROW = "struct<id:string,display_title:string,docna:map<string,struct<docna:string>>,repnme:struct<repnme:string>,docdt:string,docty:string,majdocty:string,count:string,lang:string,authors:map<string,struct<author:string>>,repnb:string,guid:string,pdfurl:string,txturl:string,url:string,projectid:string,dois:string>"
ITEM_ROW = "struct<uuid:string,handle:string,name:string,metadata:map<string,array<struct<value:string>>>,bundles:array<struct<name:string,bitstreams:array<struct<uuid:string,name:string,sizeBytes:bigint,sequenceId:int,description:string>>>>>"
PROJECT_ROW = "struct<id:string,project_name:string,countryshortname:string,regionname:string,status:string,boardapprovaldate:string,totalamt:string,curr_total_commitment:string,grantamt:string,major_sectors:array<struct<major_sector:struct<major_sector_name:string,sectors:array<struct<sector_name:string,sector_percent:string>>>>>>"


def reports(spark, query: str = "", filters: dict[str, str] | None = None, start: str | None = None, end: str | None = None, sort: str | None = None, **io) -> DataFrame:
    """Document search; filters are exact values, several joined by ``;``."""
    params = {"format": "json", "qterm": query, "strdate": start, "enddate": end, "srt": sort} | {f"{k}_exact": "^".join(v.split(";")) for k, v in (filters or {}).items()}
    pages = scan(spark, "reports", "wds", params, **io)
    found = F.map_filter(F.from_json(F.get_json_object("body", "$.documents"), f"map<string,{REPORT_ROW}>"), lambda k, v: F.startswith(k, F.lit("D")))
    return tidy.report_documents(pages.select(F.explode(F.map_values(found)).alias("d")).select("d.*"))


def report_lookup(docs: DataFrame, ids: list[str]) -> DataFrame:
    """Documents by id (with or without its prefixes), long identifier or report number."""
    bare = [i.removeprefix("wds:").removeprefix("D") for i in ids]
    long = [i for i in bare if i.isdigit() and len(i) >= 12]
    return docs.where(F.col("id").isin(*bare) | F.col("guid").isin(*long) | F.col("report_no").isin(*ids))


def repository_search(spark, query: str = "", doctype: str | None = None, author: str | None = None, start: str | None = None, end: str | None = None, **io) -> DataFrame:
    params = {"query": query, "f.entityType": "Publication,equals", "f.itemtype": doctype and f"{doctype},equals", "f.author": author and f"{author},contains", "f.dateIssued": (start or end) and f"[{start or '*'} TO {end or '*'}],equals", "embed": "bundles/bitstreams"}
    pages = scan(spark, "repository", "discover/search/objects", params, **io)
    rows = _rows(pages, "$._embedded.searchResult._embedded.objects", f"struct<_embedded:struct<indexableObject:{ITEM_ROW}>>")
    return tidy.repository_items(rows.select("_embedded.indexableObject.*"))


def repository_pdf(items: DataFrame) -> DataFrame:
    """The best PDF of each item."""
    files = items.select("uuid", "title", F.explode("pdfs").alias("f")).select("uuid", "title", F.col("f.name").alias("name"), F.col("f.sequenceId").alias("sequence"), F.col("f.uuid").alias("file"))
    return ranking.best_pdf(files, "uuid", "name", "sequence")


def project_search(spark, query: str = "", filters: dict[str, str] | None = None, **io) -> DataFrame:
    pages = scan(spark, "projects", "projects", {"format": "json", "qterm": query} | {f"{k}_exact": "^".join(v.split(";")) for k, v in (filters or {}).items()}, **io)
    rows = pages.select(F.explode(F.map_values(F.from_json(F.get_json_object("body", "$.projects"), f"map<string,{PROJECT_ROW}>"))).alias("p")).select("p.*")
    number = lambda c: periods.amount(F.regexp_replace(c, ",", ""))
    sectors = F.flatten(F.transform("major_sectors", lambda m: F.transform(m["major_sector"]["sectors"], lambda s: F.struct(s["sector_name"].alias("name"), s["sector_percent"].alias("percent")))))
    return tidy.projects(rows.select("id", F.col("project_name").alias("name"), sectors.alias("sectors"), F.array().cast("array<string>").alias("themes"), number(F.col("totalamt")).alias("commitment"), number(F.col("curr_total_commitment")).alias("current_amount"), number(F.col("grantamt")).alias("grant_amount"), "status"))


# SDMX, series, cubes ----------------------------------------------------------------------------------------------


def sdmx(spark, provider: str, flow: str, key: str = "all", start: str | None = None, end: str | None = None, last: int | None = None, **io) -> DataFrame:
    """Observations of a flow by provider name or base address, as (dims, labels, period, value, attrs)."""
    agency, _, rest = flow.partition("/")
    params = {"startPeriod": start, "endPeriod": end, "lastNObservations": last, "format": "jsondata"}
    pages = scan(spark, Service(SDMX.get(provider, provider)), f"data/{agency},{rest.replace('/', ',')}/{key}" if rest else f"data/{flow}/{key}", params, **io)
    return payloads.sdmx_json(pages)


def exchange_rate(spark, currency: str, frequency: str = "D", last: int = 10, **io) -> DataFrame:
    return sdmx(spark, "ecb", "EXR", f"{frequency}.{currency.upper()}.EUR.SP00.A", last=last, **io)


def consumer_prices(spark, area: str, item: str = "000000", measure: str = "ANR", last: int = 10, **io) -> DataFrame:
    return sdmx(spark, "ecb", "HICP", f"M.{area.upper()}.N.{item}.4D0.{measure}", last=last, **io)


SERIES_ROW = "struct<provider_code:string,dataset_code:string,dataset_name:string,series_code:string,series_name:string,`@frequency`:string,dimensions:map<string,string>,indexed_at:string,period:array<string>,period_start_day:array<string>,value:array<string>>"


def series(spark, ids: list[str], start: str | None = None, end: str | None = None, **io) -> DataFrame:
    """Observations of series ``provider/dataset/series``; unequal arrays end with the shorter one, missing values go."""
    pages = scan(spark, "series", "series", {"series_ids": ",".join(ids), "observations": 1, "metadata": 0}, **io)
    return series_observations(_rows(pages, "$.series.docs", SERIES_ROW), start, end)


def series_observations(docs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    n = F.least(F.size("period"), F.size("value"))
    cells = F.arrays_zip(F.slice("period", F.lit(1), n).alias("period"), F.slice("value", F.lit(1), n).alias("value"), F.slice(F.coalesce("period_start_day", F.col("period")), F.lit(1), n).alias("day"))
    rows = docs.select(F.concat_ws("/", "provider_code", "dataset_code", "series_code").alias("series_id"), nested.entity_of(F.col("dimensions")).alias("entity"), nested.frequency_of(F.col("@frequency"), F.col("dimensions")).alias("frequency"), F.explode(cells).alias("c"))
    rows = rows.select("series_id", "entity", "frequency", F.col("c.period").alias("period"), F.coalesce("c.day", "c.period").alias("day"), "c.value")
    rows = tidy.drop_missing(rows, "value")
    if start:
        rows = rows.where(F.col("day") >= periods.period_bound(F.lit(start)))
    if end:
        rows = rows.where(F.col("day") <= periods.period_bound(F.lit(end), end=True))
    return rows.withColumn("value", F.col("value").try_cast("double")).drop("day")


def cube(spark, dataset: str, filters: dict[str, list[str]] | None = None, **io) -> DataFrame:
    """Cells of a JSON-stat dataset."""
    return payloads.json_stat(scan(spark, "cubes", f"statistics/1.0/data/{dataset}", {"format": "JSON"} | (filters or {}), **io))


# Other statistics -------------------------------------------------------------------------------------------------

GOAL_ROW = "struct<series:string,seriesDescription:string,indicator:array<string>,geoAreaCode:string,geoAreaName:string,timePeriodStart:double,value:string,attributes:map<string,string>,dimensions:map<string,string>,source:string,footnotes:array<string>>"
HEALTH_ROW = "struct<IndicatorCode:string,SpatialDimType:string,SpatialDim:string,TimeDim:int,Dim1Type:string,Dim1:string,Dim2:string,Dim3:string,NumericValue:double,Value:string,Low:double,High:double>"
EDUCATION_ROW = "struct<indicatorId:string,geoUnit:string,year:int,value:double,magnitude:string,qualifier:string>"


def goals(spark, series_codes: list[str], areas: list[str] | None = None, start: int | None = None, end: int | None = None, dims: tuple[str, ...] = ("Age", "Sex"), totals: dict[str, list[str]] | None = None, area_table: DataFrame | None = None, **io) -> DataFrame:
    rows = _rows(scan(spark, "goals", "Series/Data", {"seriesCode": series_codes, "areaCode": areas, "timePeriodStart": start, "timePeriodEnd": end}, **io), "$.data", GOAL_ROW)
    x = tidy.goal_observations(rows, list(dims), area_table).where(masks.in_years(F.col("timePeriodStart"), start, end))
    return tidy.only_totals(x, totals) if totals else x


def health(spark, indicator: str, countries: list[str] | None = None, start: int | None = None, end: int | None = None, **io) -> DataFrame:
    """Health indicators; the filter runs at the service and again here."""
    keep, text = masks.odata_filter({"SpatialDim": countries} if countries else None, {"TimeDim": start} if start else None, {"TimeDim": end} if end else None)
    return _rows(scan(spark, "health", indicator, {"$filter": text}, **io), "$.value", HEALTH_ROW).where(keep).orderBy("SpatialDim", F.col("TimeDim").cast("string"))


def education(spark, indicators: list[str], countries: list[str], names: DataFrame | None = None, **io) -> DataFrame:
    rows = _rows(scan(spark, "education", "data/indicators", {"indicator": indicators, "geoUnit": countries}, **io), "$.records", EDUCATION_ROW)
    return rows if names is None else rows.join(names.select(F.col("id").alias("indicatorId"), "name"), "indicatorId", "left").withColumn("name", F.coalesce("name", F.lit("")))


def displacement(spark, table: str, columns: list[str], origin: str | None = None, asylum: str | None = None, years: tuple[int, int] | None = None, **io) -> DataFrame:
    """Population tables; an origin or asylum that isn't asked for is summed over."""
    params = {"coo": origin, "coa": asylum, "yearFrom": years and years[0], "yearTo": years and years[1]}
    rows = _rows(scan(spark, "displacement", table, params, **io), "$.items", "struct<" + ",".join(f"{c}:string" for c in columns) + ">")
    return tidy.displacement_rows(rows, columns)


def trade(spark, reporter: str, partner: str, flow: str, commodity: str, period: str, **io) -> tuple[DataFrame, Column]:
    """A preview of trade rows, and whether it was cut at the service's limit (as an aggregate)."""
    rows = _rows(scan(spark, "trade", "C/A/HS", {"reporterCode": reporter, "partnerCode": partner, "flowCode": flow, "cmdCode": commodity, "period": period}, **io), "$.data", "struct<reporterISO:string,partnerISO:string,flowCode:string,cmdCode:string,period:string,primaryValue:double>")
    return rows.orderBy("period", "reporterISO", "partnerISO", "flowCode", "cmdCode"), F.count("*") >= PREVIEW_ROWS


# Literature -------------------------------------------------------------------------------------------------------

WORK_ROW = "struct<id:string,doi:string,title:string,publication_year:int,cited_by_count:bigint,open_access:struct<is_oa:boolean,oa_url:string>,abstract_inverted_index:map<string,array<int>>,authorships:array<struct<author:struct<display_name:string>>>>"
REGISTRY_ROW = "struct<DOI:string,title:array<string>,subtitle:array<string>,author:array<struct<given:string,family:string,name:string>>,issued:struct<`date-parts`:array<array<int>>>,abstract:string,`is-referenced-by-count`:bigint>"
PAPER_ROW = "struct<paperId:string,title:string,abstract:string,year:int,citationCount:bigint,openAccessPdf:struct<url:string>,externalIds:map<string,string>,authors:array<struct<name:string>>>"


def _item(rows: DataFrame, source: str, order: int, page: str = "page", place: str = "i", size: int = 100, **columns: Column) -> DataFrame:
    rank = ((F.col(page) - 1) * size + F.col(place) + 1).cast("int")
    fixed = {"source": F.lit(source), "source_order": F.lit(order), "rank": rank}
    return rows.select(*[c.alias(n) for n, c in (fixed | columns).items()])


def _numbered(pages: DataFrame, at: str, ddl: str) -> DataFrame:
    return pages.select("page", F.posexplode(F.from_json(F.get_json_object("body", at), f"array<{ddl}>")).alias("i", "r")).select("page", "i", "r.*")


def openalex(spark, query: str, filters: str | None = None, order: int = 0, host: str | None = None, **io) -> DataFrame:
    x = _numbered(scan(spark, "openalex", "works", {"search": query, "filter": filters}, **io), "$.results", WORK_ROW)
    if host:
        x = x.where(masks.lands_on(F.array("open_access.oa_url"), host))
    return _item(x, "openalex", order, doi=norm_doi(F.col("doi")), title=clean_text(F.col("title")), year=F.col("publication_year"), authors=F.transform("authorships", lambda a: a["author"]["display_name"]), abstract=nested.inverted_to_text(F.col("abstract_inverted_index")), cited_by=F.col("cited_by_count"), is_oa=F.col("open_access.is_oa"), item_id=F.col("id"))


def crossref(spark, query: str, filters: str | None = None, order: int = 1, doi_prefix: str | None = None, **io) -> DataFrame:
    x = _numbered(scan(spark, "crossref", "works", {"query": query, "filter": filters}, **io), "$.message.items", REGISTRY_ROW)
    if doi_prefix:
        x = x.where(masks.in_series(F.lower("DOI"), F.array().cast("array<string>"), prefix=doi_prefix))
    title = F.concat_ws(": ", F.get("title", F.lit(0)), F.get("subtitle", F.lit(0)))
    year = F.get(F.get(F.col("issued.date-parts"), F.lit(0)), F.lit(0))
    return _item(x, "crossref", order, doi=norm_doi(F.col("DOI")), title=clean_text(title), year=year, authors=F.transform("author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"]))), abstract=clean_text(F.col("abstract")), cited_by=F.col("is-referenced-by-count"), is_oa=F.lit(None).cast("boolean"), item_id=F.concat(F.lit("crossref:"), F.lower("DOI")))


def semantic(spark, query: str, order: int = 2, **io) -> DataFrame:
    x = _numbered(scan(spark, "semantic", "paper/search", {"query": query, "fields": "title,abstract,year,citationCount,openAccessPdf,externalIds,authors"}, **io), "$.data", PAPER_ROW)
    return _item(x, "semantic", order, doi=norm_doi(F.element_at("externalIds", F.lit("DOI"))), title=clean_text(F.col("title")), year=F.col("year"), authors=F.transform("authors", lambda a: a["name"]), abstract=F.col("abstract"), cited_by=F.col("citationCount"), is_oa=F.col("openAccessPdf.url").isNotNull(), item_id=F.concat(F.lit("s2:"), "paperId"))


def arxiv(spark, query: str, categories: list[str] | None = None, order: int = 3, start: int = 0, limit: int = 100, **io) -> DataFrame:
    """Entries of the feed from ``start`` on, ``limit`` at most; all words of the query, any of the categories."""
    asked = " AND ".join([f"all:{w}" for w in query.split()] + (["(" + " OR ".join(f"cat:{c}" for c in categories) + ")"] if categories else []))
    x = payloads.atom_items(scan(spark, "arxiv", "query", {"search_query": asked, "start": start or None, "max_results": limit}, **io))
    if categories:
        x = x.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    x = ranking.rank(x, F.col("date").desc(), F.col("id"))
    return x.select(F.lit("arxiv").alias("source"), F.lit(order).alias("source_order"), "rank", "doi", "title", F.left("date", F.lit(4)).try_cast("int").alias("year"), "authors", "abstract", F.lit(None).cast("bigint").alias("cited_by"), F.lit(True).alias("is_oa"), F.concat(F.lit("arxiv:"), "id").alias("item_id"))


def core(spark, query: str, limit: int, order: int = 4, **io) -> DataFrame:
    """Outputs by DOI, else by title and year, the first of each; repeats go before the limit."""
    x = _numbered(scan(spark, "core", "search/works", {"q": query}, **io), "$.results", "struct<id:string,doi:string,title:string,abstract:string,yearPublished:int,citationCount:bigint,authors:array<struct<name:string>>>")
    from ..functions.text import norm_title

    key = F.coalesce(norm_doi(F.col("doi")), F.concat_ws("|", norm_title(F.col("title")), F.col("yearPublished").cast("string")))
    x = ranking.keep_first(x.withColumn("_key", key), ["_key"], F.struct("page", "i"))
    items = _item(x, "core", order, doi=norm_doi(F.col("doi")), title=clean_text(F.col("title")), year=F.col("yearPublished"), authors=F.transform("authors", lambda a: a["name"]), abstract=F.col("abstract"), cited_by=F.col("citationCount"), is_oa=F.lit(True), item_id=F.concat(F.lit("core:"), "id"))
    return items.orderBy("rank").limit(limit)


def nber(spark, query: str, order: int = 5, **io) -> DataFrame:
    """Working papers of the listing: the number gives the DOI and the file's address; dates are ``January 2011``."""
    x = _numbered(scan(spark, "nber", "search", {"q": query}, **io), "$.results", "struct<title:string,authors:array<string>,displaydate:string,abstract:string,url:string>")
    number = F.element_at(F.split(F.rtrim(F.col("url"), F.lit("/")), "/"), -1)
    doi = F.when(number.rlike(r"^w\d+$"), F.concat(F.lit("10.3386/"), number))
    pdf = F.when(doi.isNotNull(), F.concat(F.lit("https://www.nber.org/system/files/working_papers/"), number, F.lit("/"), number, F.lit(".pdf")))
    items = _item(x, "nber", order, doi=doi, title=clean_text(F.col("title")), year=periods.year_in_text(F.col("displaydate")), authors=F.transform("authors", clean_text), abstract=F.nullif(clean_text(F.col("abstract")), F.lit("")), cited_by=F.lit(None).cast("bigint"), is_oa=F.lit(True), item_id=F.concat(F.lit("nber:"), number), date=F.coalesce(periods.iso_month(F.trim("displaydate")), periods.year_in_text(F.col("displaydate")).cast("string")), pdf_url=pdf)
    return items


def availability(spark, provider: str, flow: str, key: str = "all", **io) -> DataFrame:
    """(dimension, code) of the codes under which a flow has data for a key."""
    body = scan(spark, Service(SDMX[provider]), f"availableconstraint/{flow}/{key}/all/all", {}, **io)
    return payloads.constraint_codes(body)


def literature(spark, query: str, sources: list[DataFrame], limit: int = 25, years: tuple[int | None, int | None] = (None, None), oa: bool = False) -> DataFrame:
    """The federated search: items of the sources merged, scored and ranked."""
    kept = [s.where(masks.in_years(F.col("year"), *years)) for s in sources]
    kept = [s.where("is_oa or is_oa is null") for s in kept] if oa else kept
    return fusion.search(kept, query.lower().split(), limit)


def open_access_candidates(unpaywall: DataFrame, works: DataFrame, patterns: DataFrame) -> DataFrame:
    """Candidate PDF links (doi, url, version, source_rank, seq) of three origins; each link once."""
    every = unpaywall.withColumn("source_rank", F.lit(1)).unionByName(works.withColumn("source_rank", F.lit(0)), allowMissingColumns=True).unionByName(patterns.withColumn("source_rank", F.lit(2)), allowMissingColumns=True)
    return ranking.keep_first(every.where(F.col("url").isNotNull() & (looks_like_pdf(F.col("url")) | (F.col("source_rank") < 2))), ["doi", "url"], F.struct("source_rank", "seq"))
