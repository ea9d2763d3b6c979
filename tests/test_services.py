import json
import zlib

import pytest
from pyspark.sql import functions as F

from statweave.sources import connector, services


def record(folder, service, path, params, body, page=1):
    s = services.SERVICES.get(service) or services.Service(services.SDMX[service])
    at = {"page": {"page": page, s.at.get("size", "per_page"): s.size}, "offset": {"offset": (page - 1) * s.size, s.at.get("size", "limit"): s.size}}.get(s.paging, {})
    url = connector.build_url(s.base, path, params | at)
    (folder / f"{zlib.crc32(url.encode()):08x}.json").write_text(body if isinstance(body, str) else json.dumps(body))


@pytest.fixture()
def io(tmp_path):
    return {"mode": "recorded", "folder": str(tmp_path)}


def test_indicator_values(spark, tmp_path, io):
    row = lambda c, iso, year, v: {"indicator": {"id": "X"}, "country": {"id": c, "value": c}, "countryiso3code": iso, "date": year, "value": v}
    record(tmp_path, "indicators", "country/all/indicator/X", {"format": "json"}, [{"page": 1, "pages": 2}, [row("FR", "FRA", "2020", 1.0), row("XN", "", "2020", 2.0)]])
    record(tmp_path, "indicators", "country/all/indicator/X", {"format": "json"}, [{"page": 2, "pages": 2}, [row("FR", "FRA", "2021", None)]], page=2)
    known = spark.createDataFrame([("XN", "LMC", True), ("FR", "FRA", False)], "iso2 string, iso3 string, aggregate boolean")
    rows = services.indicator_values(spark, ["X"], country_table=known, **io).collect()
    assert [(r["iso3"], r["period"], r["value"]) for r in rows] == [("FRA", "2020", 1.0), ("LMC", "2020", 2.0)]
    assert [r["iso3"] for r in services.indicator_values(spark, ["X"], country_table=known, economies_only=True, keep_empty=True, **io).collect()] == ["FRA", "FRA"]
    with pytest.raises(ValueError):
        services.indicator_values(spark, ["X"], date="2020", mrv=1)


def test_reports_and_series(spark, tmp_path, io):
    doc = {"id": "1", "docna": {"0": {"docna": "Growth : chapter two"}}, "display_title": "Growth", "dois": "10.1596/A;10.1596/b", "authors": {"0": {"author": "X"}}, "guid": "123456789012"}
    record(tmp_path, "reports", "wds", {"format": "json", "qterm": "growth"}, {"total": 1, "documents": {"D1": doc, "facets": {}}})
    r = services.reports(spark, "growth", **io)
    assert [(x["title"], x["doi"], x["authors"]) for x in r.collect()] == [("Growth : chapter two", "10.1596/a", ["X"])]
    assert services.report_lookup(r, ["wds:1"]).count() == services.report_lookup(r, ["123456789012"]).count() == 1
    docs = {"series": {"docs": [{"provider_code": "P", "dataset_code": "D", "series_code": "S", "@frequency": "annual", "dimensions": {"geo": "FR"}, "period": ["2019", "2020", "2021"], "period_start_day": ["2019-01-01"], "value": [1, "NA"]}]}}
    record(tmp_path, "series", "series", {"series_ids": "P/D/S", "observations": 1, "metadata": 0}, docs)
    assert [(x["entity"], x["period"], x["value"]) for x in services.series(spark, ["P/D/S"], start="2019", **io).collect()] == [("FR", "2019", 1.0)]


def test_literature(spark, tmp_path, io):
    work = {"id": "W1", "doi": "https://doi.org/10.1/A", "title": "Trade and growth in towns", "publication_year": 2020, "cited_by_count": 3, "open_access": {"is_oa": True}, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "A B"}}]}
    record(tmp_path, "openalex", "works", {"search": "trade"}, {"results": [work]})
    item = {"DOI": "10.1/a", "title": ["Trade and growth in towns"], "author": [{"given": "A", "family": "B"}, {"name": "C"}], "issued": {"date-parts": [[2020, 3]]}, "is-referenced-by-count": 5}
    record(tmp_path, "crossref", "works", {"query": "trade"}, {"message": {"items": [item]}})
    out = services.literature(spark, "trade", [services.openalex(spark, "trade", **io), services.crossref(spark, "trade", **io)]).collect()
    assert len(out) == 1 and (out[0]["cited_by"], out[0]["abstract"], out[0]["authors"], out[0]["sources"]) == (5, "a b", ["A B", "C"], 2)


def test_candidates(spark):
    mk = lambda rows: spark.createDataFrame(rows, "doi string, url string, version string, seq int")
    out = services.open_access_candidates(mk([("d", "http://a/x.pdf", "publishedVersion", 1)]), mk([("d", "http://a/x.pdf", None, 2)]), mk([("d", "http://b/page", None, 3)]))
    assert [(r["url"], r["source_rank"]) for r in out.collect()] == [("http://a/x.pdf", 0)]


def test_exchange_rate_key(spark, tmp_path, io):
    record(tmp_path, "ecb", "data/EXR/D.USD.EUR.SP00.A", {"startPeriod": None, "endPeriod": None, "lastNObservations": 10, "format": "jsondata"}, {"dataSets": [{"series": {"0": {"observations": {"0": [1.1]}}}}], "structure": {"dimensions": {"series": [{"id": "CURRENCY", "values": [{"id": "USD"}]}], "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2024-01-02"}]}]}}})
    r = services.exchange_rate(spark, "usd", **io).first()
    assert (r["dims"]["CURRENCY"], r["period"], float(r["value"])) == ("USD", "2024-01-02", 1.1)
    assert services.exchange_rate(spark, "chf", **io).where(F.lit(True)).count() == 0


def test_other_statistics(spark, tmp_path, io):
    goal = lambda sex, v: {"series": "S", "indicator": ["1.1.1"], "geoAreaCode": "250", "geoAreaName": "France", "timePeriodStart": 2020.0, "value": v, "dimensions": {"Sex": sex}, "footnotes": ["a", "", "b"]}
    record(tmp_path, "goals", "Series/Data", {"seriesCode": ["S"], "areaCode": None, "timePeriodStart": None, "timePeriodEnd": None}, {"totalPages": 1, "data": [goal("_T", "1"), goal("F", "2")]})
    r = services.goals(spark, ["S"], totals={"Sex": ["_T"], "Age": ["_T"]}, **io).collect()
    assert [(x["Sex"], x["value"], x["footnotes"], x["indicator"]) for x in r] == [("_T", "1", "a | b", "1.1.1")]
    row = lambda c, y: {"IndicatorCode": "I", "SpatialDim": c, "TimeDim": y, "NumericValue": 1.5}
    record(tmp_path, "health", "I", {"$filter": "SpatialDim eq 'FRA' and TimeDim ge 2019"}, {"value": [row("FRA", 2020), row("FRA", 2018)]})
    assert [x["TimeDim"] for x in services.health(spark, "I", ["FRA"], start=2019, **io).collect()] == [2020]
    record(tmp_path, "education", "data/indicators", {"indicator": ["E"], "geoUnit": ["FRA"]}, {"records": [{"indicatorId": "E", "geoUnit": "FRA", "year": 2020, "value": 2.0}]})
    names = spark.createDataFrame([("other", "x")], "id string, name string")
    assert services.education(spark, ["E"], ["FRA"], names, **io).first()["name"] == ""
    record(tmp_path, "displacement", "population", {"coo": "SYR", "coa": None, "yearFrom": None, "yearTo": None}, {"maxPages": 1, "items": [{"year": "2020", "refugees": "-"}, {"year": "2021", "refugees": "12"}]})
    assert [x["refugees"] for x in services.displacement(spark, "population", ["year", "refugees"], origin="SYR", **io).collect()] == ["", "12"]
    record(tmp_path, "trade", "C/A/HS", {"reporterCode": "251", "partnerCode": "0", "flowCode": "X", "cmdCode": "TOTAL", "period": "2020"}, {"data": [{"reporterISO": "FRA", "partnerISO": "W00", "flowCode": "X", "cmdCode": "TOTAL", "period": "2020", "primaryValue": 5.0}]})
    rows, cut = services.trade(spark, "251", "0", "X", "TOTAL", "2020", **io)
    assert rows.count() == 1 and rows.agg(cut.alias("c")).first()["c"] is False


def test_repository_and_projects(spark, tmp_path, io):
    item = {"uuid": "u", "handle": "h", "metadata": {"dc.title": [{"value": "Jobs"}], "dc.title.subtitle": [{"value": "A report"}], "okr.doctype": [{"value": "Publications::Report"}]}, "bundles": [{"name": "ORIGINAL", "bitstreams": [{"uuid": "1", "name": "Summary.pdf", "sequenceId": 1}, {"uuid": "2", "name": "Full.PDF", "sequenceId": None}, {"uuid": "3", "name": "data.xlsx"}]}, {"name": "TEXT", "bitstreams": [{"uuid": "4", "name": "x.pdf"}]}]}
    record(tmp_path, "repository", "discover/search/objects", {"query": "jobs", "f.entityType": "Publication,equals", "embed": "bundles/bitstreams"}, {"_embedded": {"searchResult": {"_embedded": {"objects": [{"_embedded": {"indexableObject": item}}]}}}})
    found = services.repository_search(spark, "jobs", **io)
    assert (found.first()["title"], found.first()["type"]) == ("Jobs: A report", "Report")
    assert services.repository_pdf(found).first()["name"] == "Full.PDF"
    project = {"id": "P1", "project_name": "Roads", "totalamt": "0", "curr_total_commitment": "1,500", "major_sectors": [{"major_sector": {"major_sector_name": "T", "sectors": [{"sector_name": "Roads", "sector_percent": "60"}]}}], "status": "Active"}
    record(tmp_path, "projects", "projects", {"format": "json", "qterm": "roads"}, {"total": 1, "projects": {"P1": project}})
    r = services.project_search(spark, "roads", **io).first()
    assert (r["amount"], r["sectors"]) == (1500, ["Roads (60%)"])


def test_paging_goes_on_to_the_last_page(spark, tmp_path, io):
    doc = lambda i: {"id": str(i), "display_title": f"T{i}"}
    asked = {"format": "json", "qterm": "g"}
    record(tmp_path, "reports", "wds", asked, {"total": 3, "documents": {"D1": doc(1), "D2": doc(2), "facets": {}}})
    record(tmp_path, "reports", "wds", asked | {"rows": 50, "os": 2}, {"total": 3, "documents": {"D3": doc(3), "facets": {}}})
    assert sorted(r["id"] for r in services.reports(spark, "g", **io).collect()) == ["1", "2", "3"]
    project = lambda i: {"id": f"P{i}", "project_name": "Roads", "totalamt": "1", "status": "Active"}
    record(tmp_path, "projects", "projects", asked, {"total": "2", "projects": {"P1": project(1)}})
    record(tmp_path, "projects", "projects", asked | {"rows": 50, "os": 1}, {"total": "2", "projects": {"P2": project(2)}})
    assert sorted(r["id"] for r in services.project_search(spark, "g", **io).collect()) == ["P1", "P2"]
    found = lambda u: {"_embedded": {"searchResult": {"page": {"size": 1, "totalPages": 2}, "_embedded": {"objects": [{"_embedded": {"indexableObject": {"uuid": u, "handle": u, "metadata": {"dc.title": [{"value": u}]}}}}]}}}}
    asked = {"query": "jobs", "f.entityType": "Publication,equals", "embed": "bundles/bitstreams"}
    record(tmp_path, "repository", "discover/search/objects", asked, found("u"))
    record(tmp_path, "repository", "discover/search/objects", asked | {"size": 1, "page": 1}, found("v"))
    assert sorted(r["title"] for r in services.repository_search(spark, "jobs", **io).collect()) == ["u", "v"]
    values = lambda code: {"series": {"num_found": 1001, "docs": [{"provider_code": "P", "dataset_code": "D", "series_code": code, "dimensions": {"geo": "FR"}, "period": ["2020"], "value": [1]}]}}
    for page, code in ((1, "S"), (2, "T")):
        record(tmp_path, "series", "series", {"series_ids": "P/D/S", "observations": 1, "metadata": 0}, values(code), page=page)
    assert sorted(r["series_id"] for r in services.series(spark, ["P/D/S"], **io).collect()) == ["P/D/S", "P/D/T"]


def test_literature_services_page_to_their_totals(spark, tmp_path, io):
    for page in (1, 2):
        record(tmp_path, "openalex", "works", {"search": "t"}, {"meta": {"count": 101}, "results": [{"id": f"W{page}", "title": f"Work number {page}"}]}, page=page)
        record(tmp_path, "crossref", "works", {"query": "t"}, {"message": {"total-results": 101, "items": [{"DOI": f"10.1/{page}", "title": ["A title"]}]}}, page=page)
        record(tmp_path, "nber", "search", {"q": "t"}, {"totalResults": 101, "results": [{"title": f"<b>Paper</b> {page}", "authors": ["<a href='x'>A B</a>"], "displaydate": "January 2011", "abstract": "", "url": f"/papers/w{page}"}]}, page=page)
    assert services.openalex(spark, "t", **io).count() == services.crossref(spark, "t", **io).count() == 2
    papers = {r["item_id"]: r for r in services.nber(spark, "t", **io).collect()}
    assert set(papers) == {"nber:w1", "nber:w2"}
    r = papers["nber:w2"]
    assert (r["doi"], r["title"], r["authors"], r["year"], r["date"], r["abstract"], r["pdf_url"]) == ("10.3386/w2", "Paper 2", ["A B"], 2011, "2011-01", None, "https://www.nber.org/system/files/working_papers/w2/w2.pdf")


def test_availability(spark, tmp_path, io):
    record(tmp_path, "imf", "availableconstraint/WEO/all/all/all", {}, "<S><s:KeyValue id='A'><c:Value>x</c:Value><c:Value>y</c:Value></s:KeyValue></S>")
    assert sorted(tuple(r) for r in services.availability(spark, "imf", "WEO", **io).collect()) == [("A", "x"), ("A", "y")]


def test_downloads(spark, tmp_path):
    from statweave.sources import downloads

    class Reply:
        def __init__(self, body, announced=None):
            self.body, self.at = body, 0
            self.headers = {"Content-Length": str(announced or len(body)), "Content-Type": "application/pdf"}

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self, n):
            self.at += n
            return self.body[self.at - n : self.at]

    def reply(url, timeout):
        if "missing" in url:
            raise OSError("404")
        return Reply(b"<html>" if "page" in url else b"%PDF-1.4 " + b"x" * (1000 if "large" in url else 10))

    rows = spark.createDataFrame([("a", "http://x/a"), ("b", "http://x/page"), ("c", "http://x/large"), ("d", "http://x/missing"), (None, "x"), ("e", None)], "id string, url string")
    got = {r["id"]: r for r in downloads.download_pdfs(rows, str(tmp_path), most=100, opener=reply).collect()}
    assert {i: r["status"] for i, r in got.items()} == {"a": "ok", "b": "not a PDF", "c": "too large", "d": "failed: 404"}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "a.pdf.json"]
    side = json.loads((tmp_path / "a.pdf.json").read_text())
    assert (side["url"], side["bytes"], side["sha256"]) == ("http://x/a", 19, got["a"]["sha256"])
