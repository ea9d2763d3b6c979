import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from statweave.operators import citations, fusion, joins, ranking, tidy
from statweave.sources import connector, files, payloads


def test_sdmx_json_series_and_flat(spark):
    structure = {
        "dimensions": {
            "series": [{"id": "FREQ", "keyPosition": 1, "values": [{"id": "A", "name": "Annual"}]}, {"id": "GEO", "keyPosition": 0, "values": [{"id": "FR", "name": "France"}, {"id": "DE", "name": "DE"}]}],
            "observation": [{"id": "TIME_PERIOD", "values": [{"id": "2020"}, {"id": "2021"}]}],
        },
        "attributes": {"series": [{"id": "UNIT", "values": [{"id": "EUR"}]}], "observation": [{"id": "OBS_STATUS", "values": [{"id": "E"}]}]},
    }
    series = {"dataSets": [{"series": {"0:0": {"attributes": [0], "observations": {"0": [1.5, 0], "1": [2.5, None]}}, "1:0": {"attributes": [None], "observations": {"1": [3]}}}}], "structure": structure}
    flat = {"data": {"dataSets": [{"observations": {"0:0:1": [7]}}], "structures": [{"dimensions": {"observation": [{"id": "GEO", "values": [{"id": "IT"}]}, {"id": "FREQ", "values": [{"id": "M"}]}, {"id": "TIME_PERIOD", "values": [{"id": "2019"}, {"id": "2022"}]}]}}]}}
    rows = payloads.sdmx_json(spark.createDataFrame([(json.dumps(series),), (json.dumps(flat),)], "body string")).collect()
    got = {(r["dims"]["GEO"], r["period"]): (float(r["value"]), r["attrs"].get("UNIT"), r["attrs"].get("OBS_STATUS"), r["labels"].get("GEO")) for r in rows}
    assert got == {("FR", "2020"): (1.5, "EUR", "E", "France"), ("FR", "2021"): (2.5, "EUR", None, "France"), ("DE", "2021"): (3.0, None, None, None), ("IT", "2022"): (7.0, None, None, None)}


def test_json_stat_sparse_and_status(spark):
    body = {"id": ["geo", "time"], "size": [2, 2], "dimension": {"geo": {"category": {"index": {"FR": 0, "DE": 1}}}, "time": {"category": {"index": ["2020", "2021"]}}}, "value": {"0": 1.0, "3": 4.0}, "status": {"1": "c"}}
    rows = payloads.json_stat(spark.createDataFrame([(json.dumps(body),)], "body string")).collect()
    assert {(r["dims"]["geo"], r["period"], r["value"], r["status"]) for r in rows} == {("FR", "2020", 1.0, None), ("DE", "2021", 4.0, None), ("FR", "2021", None, "c")}


def test_sdmx_ml(spark):
    generic = '<m:D xmlns:m="x"><m:DataSet><g:Series><g:SeriesKey><g:Value id="GEO" value="FR"/></g:SeriesKey><g:Obs><g:ObsDimension value="2020"/><g:ObsValue value="5"/></g:Obs></g:Series></m:DataSet></m:D>'
    r = payloads.sdmx_ml_generic(spark.createDataFrame([(generic,)], "body string")).collect()
    assert [(x["dims"], x["period"], x["value"]) for x in r] == [({"GEO": "FR"}, "2020", "5")]
    specific = '<D><DataSet><Series GEO="FR" FREQ="A"><Obs TIME_PERIOD="2020" OBS_VALUE="5"/><Obs TIME_PERIOD="2021"/></Series></DataSet></D>'
    r = payloads.sdmx_ml_specific(spark.createDataFrame([(specific,)], "body string")).orderBy("period").collect()
    assert [(x["dims"]["GEO"], x["period"], x["value"]) for x in r] == [("FR", "2020", "5"), ("FR", "2021", "")]


def test_envelope_and_atom(spark):
    ok = json.dumps([{"page": 1}, [{"id": "a"}, {"id": "b"}]])
    assert payloads.envelope(spark.createDataFrame([(ok,)], "body string"), "struct<id:string>").count() == 2
    bad = json.dumps([{"message": [{"id": "1", "key": "k", "value": "not there"}]}])
    with pytest.raises(Exception, match="not there"):
        payloads.envelope(spark.createDataFrame([(bad,)], "body string"), "struct<id:string>").collect()
    feed = "<feed><entry><id>http://arxiv.org/abs/2101.00001v2</id><title>A\n  b</title><published>2021-01-01T00:00:00Z</published><author><name>X Y</name></author><category term='cs.CL'/></entry></feed>"
    r = payloads.atom_items(spark.createDataFrame([(feed,)], "body string")).first()
    assert (r["id"], r["title"], r["doi"], r["authors"], r["categories"]) == ("2101.00001", "A b", "10.48550/arxiv.2101.00001", ["X Y"], ["cs.CL"])


def test_category_tree(spark):
    nodes = spark.createDataFrame([("1", None, "A", None), ("2", "1", "B", None), ("3", "2", "C", "ds1"), ("4", "1", "D", "ds1")], "id string, parent string, name string, dataset string")
    assert payloads.category_leaves(nodes).collect()[0]["path"] == "A / B / C"


def test_paging_retry_and_recorded_mode(spark, tmp_path):
    import urllib.error
    import zlib

    waits = []
    calls = {"n": 0}

    class Reply:
        status, headers = 200, {}

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return b"\xef\xbb\xbfok"

    def opener(request, timeout):
        calls["n"] += 1
        if calls["n"] < 3:
            raise urllib.error.HTTPError("u", 503, "", {"Retry-After": "90"}, None)
        return Reply()

    assert connector.get("http://x", opener, waits.append) == "ok" and waits == [60.0, 60.0]
    base = "http://service"
    for n in (1, 2):
        url = connector.build_url(base, "rows", {"format": "json", "page": n, "per_page": 100})
        (tmp_path / f"{zlib.crc32(url.encode()):08x}.json").write_text(json.dumps([{"pages": 2}, [n]]))
    connector.register(spark)
    df = spark.read.format("paged_json").options(base=base, path="rows|other", params='{"format":"json"}', mode="recorded", folder=str(tmp_path)).load()
    assert sorted(r["page"] for r in df.collect()) == [1, 2]
    assert connector.build_url("http://a/", "/b", {"x": [1, 2], "y": None, "z": ""}) == "http://a/b?x=1&x=2"
    assert connector.message('{"message":"no"}') == "no" and connector.message("<b>x</b> y") == "x y"


def test_mixed_releases_follow_order(spark):
    rows = [("p", "WEO", "2020-01-01", 1), ("p", "WEO:2020-10", "2020-10-01", 2), ("p", "weo", "2021-01-01", 3), ("p", "X:1", "", 4), ("p", "X:2", "", 5)]
    out = ranking.collapse_releases(spark.createDataFrame(rows, "provider string, code string, indexed_at string, seq int")).collect()
    assert {(r["code"], r["hidden"]) for r in out} == {("weo", 2), ("X:2", 1)}


def test_entity_resolution_matches_a_sequential_fold(spark):
    import random

    random.seed(4)
    rows = []
    for s in range(3):
        for k in range(1, 25):
            rows.append((f"s{s}", s, k, random.choice([None, f"10.1/{random.randint(1, 9)}"]), f"a long enough title {random.randint(1, 8)}", random.choice([None, 0, 2000, 2001, 2003]), f"{s}-{k:02d}"))
    df = spark.createDataFrame(rows, "source string, source_order int, rank int, doi string, title string, year int, item_id string")
    got = {r["item_id"]: r["group_id"] for r in fusion.resolve(df).collect()}
    groups, want = [], {}
    for _, _, _, doi, title, year, i in sorted(rows, key=lambda r: (r[1], r[2])):
        g = next((g for g in groups if doi and doi in g["dois"]), None) or next((g for g in groups if g["t"] == title and (not year or not g["y"] or abs(year - g["y"]) <= 1)), None)
        if g is None:
            g = {"dois": [], "t": title, "y": year or 0, "id": i}
            groups.append(g)
        g["y"] = g["y"] or year or 0
        if doi and doi not in g["dois"]:
            g["dois"].append(doi)
        want[i] = g["id"]
    assert got == want


def plain_groups(rows):
    """Groups of (order, rank, doi, title, year, item_id) by the rule, item by item."""
    groups, want = [], {}
    for order, rank, doi, title, year, i in sorted(rows, key=lambda r: (r[0], r[1] or 99, r[5])):
        g = next((g for g in groups if doi and doi in g["dois"]), None)
        g = g or next((g for g in groups if title and g["t"] == title and (not year or not g["y"] or abs(year - g["y"]) <= 1)), None)
        if g is None:
            g = {"dois": [], "t": title, "y": year or 0, "id": i, "seq": order * 1_000_000 + (rank or 99)}
            groups.append(g)
        g["y"], g["t"] = g["y"] or year or 0, g["t"] or title
        if doi and doi not in g["dois"]:
            g["dois"].append(doi)
        want[i] = g
    return {i: (g["id"], g["seq"], g["dois"][0] if g["dois"] else None, g["dois"][1:]) for i, g in want.items()}


def resolved(spark, rows):
    df = spark.createDataFrame([(f"s{r[0]}", *r) for r in rows], "source string, source_order int, rank int, doi string, title string, year int, item_id string")
    return {r["item_id"]: (r["group_id"], r["group_seq"], r["doi"], r["other_dois"]) for r in fusion.resolve(df).collect()}


def test_resolution_of_many_and_of_large_blocks(spark):
    import random

    random.seed(8)
    rows = []
    for block in range(60):  # works with missing titles, years and DOIs, each block apart from the others
        for k in range(random.randint(1, 12)):
            rows.append((k % 3, random.choice([0, None, *range(1, 9)]), random.choice([None, f"10.{block}/{random.randint(1, 4)}"]), random.choice([None, f"block {block} title number {random.randint(1, 2)}"]), random.choice([None, 0, *range(2000, 2006)]), f"{block}-{k:02d}"))
    assert resolved(spark, rows) == plain_groups(rows)
    many = [(0, 1, f"10.5/{k}", f"a title of its own {k}", 2000, f"i{k}") for k in range(5000)]
    large = [(1, k + 1, f"10.6/{k}", "one title of very many works", 3 * k + 1, f"l{k:05d}") for k in range(10000)]
    again = [(2, k + 1, None, "one title of very many works", 3 * k + 2, f"m{k:05d}") for k in range(10000)]
    began = time.perf_counter()
    got = resolved(spark, [*many, *large, *again])
    assert time.perf_counter() - began < 60
    assert len(got) == 25000 and all(got[f"i{k}"][0] == f"i{k}" for k in range(5000)) and all(got[f"m{k:05d}"] == got[f"l{k:05d}"] == (f"l{k:05d}", 1_000_001 + k, f"10.6/{k}", []) for k in range(10000))


def test_merging_folds_once_without_a_frame_for_each_work(spark, small):
    from statweave.plans import recorded

    plan = recorded.merged_items(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "FlatMapGroups" not in plan


def test_merging_takes_first_fields_in_source_order(spark):
    rows = [("b", 1, 2, "10.1/z", "A title that is long", 0, ["Q", "R"], "later", 7, None, "y"), ("a", 0, 5, "10.1/z", "A title that is long", None, None, "", None, False, "x"), ("b", 1, 1, "10.1/z", "Other words of a title", 1999, ["P", "S"], None, 3, True, "w"), ("c", 2, 4, None, None, 2001, ["T"], None, None, None, "v")]
    items = spark.createDataFrame(rows, fusion.ITEM)
    got = {r["group_id"]: r for r in fusion.best_of_group(items, fusion.resolve(items)).collect()}
    r = got["x"]
    assert (r["title"], r["abstract"], r["year"], r["authors"], r["cited_by"], r["is_oa"], r["item_ids"], r["sources"]) == ("A title that is long", "later", 1999, ["P", "S"], 7, True, ["w", "x", "y"], 2)
    assert r["rrf"] == pytest.approx(1 / 65 + 1 / 61) and got["v"]["item_ids"] == ["v"] and got["v"]["year"] == 2001
    assert fusion.resolve(items.limit(0)).count() == 0


def test_search_ranks_and_merges(spark):
    a = spark.createDataFrame([("a", 0, 1, "10.1/x", "Growth and trade in cities", 2020, ["A B"], None, 5, False, "a1")], fusion.ITEM)
    b = spark.createDataFrame([("b", 1, 3, "https://doi.org/10.1/X", "Growth and trade in cities", 2020, ["A B", "C D"], "text", 9, True, "b1"), ("b", 1, 1, None, "Something else entirely", 2001, ["Z"], "", 0, False, "b2")], fusion.ITEM)
    r = fusion.search([a, b], ["growth", "trades"]).collect()
    assert (r[0]["item_ids"], r[0]["cited_by"], r[0]["is_oa"], len(r[0]["authors"]), r[0]["coverage"], r[0]["abstract"]) == (["a1", "b1"], 9, True, 2, 1.0, "text")


def brute_window(words, quote):
    best = (0.0, 0, 0)
    for size in (len(quote), len(quote) + max(1, len(quote) // 5)):
        size = min(size, len(words))
        for i in range(len(words) - size + 1):
            both = sum((Counter(words[i : i + size]) & Counter(quote)).values()) / len(quote)
            if both > best[0]:
                best = (both, i, i + size)
    return best


def test_fuzzy_windows():
    import random

    random.seed(2)
    for _ in range(300):
        words = [random.choice("abcde") for _ in range(random.randint(1, 30))]
        quote = [random.choice("abcde") for _ in range(random.randint(4, 9))]
        assert citations.best_window(words, quote) == brute_window(words, quote)


def test_quote_tiers_and_verdicts(spark):
    pages = spark.createDataFrame([("d", 1, "aaaa The cost-\nbenefit ratio fell."), ("d", 2, "It rose again in the year"), ("d", 3, "of plenty, they say. Alpha beta gamma delta epsilon zeta.")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "aa"), (2, "costbenefit ratio"), (3, "in the year of plenty"), (4, "alpha beta gamma wrong epsilon zeta"), (5, "not there at all, ever")], "quote_id int, quote string")
    assert citations.exact_hits(pages, quotes).where("quote_id = 1").count() == 3
    hits = citations.find_quotes(pages, quotes).collect()
    assert {(r["quote_id"], r["page"], r["tier"]) for r in hits if r["quote_id"] != 1} == {(2, 1, "normalised"), (3, 2, "normalised"), (4, 3, "fuzzy")}
    claims = spark.createDataFrame([(2, "d", 1), (2, "d", 2), (4, "d", 3), (5, "d", 1), (2, "e", 1)], "quote_id int, doc_id string, cited_page int")
    v = citations.verdicts(claims, citations.find_quotes(pages, quotes), pages).collect()
    assert {(r["quote_id"], r["doc_id"], r["cited_page"]): r["verdict"] for r in v} == {(2, "d", 1): "FOUND", (2, "d", 2): "OTHER PAGE", (4, "d", 3): "CHECK", (5, "d", 1): "NOT FOUND", (2, "e", 1): "NO TEXT"}


def test_ellipsis_and_columns(spark):
    pages = spark.createDataFrame([("d", 1, "alpha one two three beta four gamma")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "alpha ... beta … gamma"), (2, "gamma ... alpha")], "quote_id int, quote string")
    assert [r["quote_id"] for r in citations.ellipsis_hits(pages, quotes).collect()] == [1]
    left, right = "some words of prose on this side", "and other words of prose on that"
    texts = ["\n".join([left + "     " + right] * 9), "\n".join([left] * 12), "\n".join(["left side word   right words go"] * 10), "\n".join([left] * 7 + [" " * 40 + right] * 4), "", None]
    pages = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", citations.two_columns(F.col("text")).alias("two"))
    assert [r["two"] for r in pages.orderBy("i").collect()] == [True, False, False, True, False, False]


def test_places_of_overlapping_occurrences(spark):
    rows = [("aaaa", "aa"), ("abcabc", "abc"), ("x😀y😀", "😀"), ("a.b", "."), (r"x\Ey\E", r"\E"), ("abc", "d"), ("", "a"), ("a", "")]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, x struct<text:string,quote:string>").select("i", citations.overlapping(F.col("x.text"), F.col("x.quote")).alias("at")).orderBy("i").collect()
    assert [r["at"] for r in got] == [[i + 1 for i in range(len(t)) if q and t.startswith(q, i)] for t, q in rows]


def test_a_hit_over_a_page_break_is_on_both_pages(spark):
    pages = spark.createDataFrame([("d", 1, "It rose in the year"), ("d", 2, "of plenty, they say.")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "in the year of plenty"), (2, "ay"), (3, "y")], "quote_id int, quote string")
    hits = citations.find_quotes(pages, quotes)
    assert {(r["quote_id"], tuple(r["pages"])) for r in hits.collect()} == {(1, (1, 2)), (2, (2,)), (3, (1,)), (3, (2,))}
    claims = spark.createDataFrame([(1, "d", 1), (1, "d", 2), (1, "d", 3)], "quote_id int, doc_id string, cited_page int")
    assert [r["verdict"] for r in citations.verdicts(claims, hits, pages).orderBy("cited_page").collect()] == ["FOUND", "FOUND", "OTHER PAGE"]


def test_only_totals(spark):
    df = spark.createDataFrame([("_T", "a", 1), ("M", "a", 2), ("_T", "b", 3)], "sex string, kind string, v int")
    assert {r["v"] for r in tidy.only_totals(df, {"sex": ["_T"], "kind": ["_T"]}).collect()} == {1, 3}


def test_code_fallbacks(spark):
    left = spark.createDataFrame([("A", "x", "1"), ("B", "x", "9"), ("C", "y", "1")], "agency string, id string, version string")
    right = spark.createDataFrame([("A", "x", "1", "exact"), ("B", "x", "2", "agency"), ("D", "y", "1", "id")], "agency string, id string, version string, name string")
    out = joins.with_fallback(left, right, [["agency", "id", "version"], ["agency", "id"], ["id"]], "name")
    assert {(r["agency"], r["name"]) for r in out.collect()} == {("A", "exact"), ("B", "agency"), ("C", "id")}


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"a","url":"https://e.org/x/"}\nnot json\n{"id":"b","url":"https://e.org/y"}\n')
    log = files.json_lines(spark, str(tmp_path / "a.jsonl"), files.SOURCE_LOG)
    assert log.count() == 2
    docs = spark.createDataFrame([("z", "http://e.org/x"), ("b", "http://none")], "source_id string, url string")
    assert {r["source_id"]: r["record_id"] for r in joins.logged_source(docs, log).collect()} == {"z": "a", "b": "b"}
    (tmp_path / "claims.json").write_text('[{"id":"1","quote":"q","page":2}]')
    assert files.claims(spark, str(tmp_path / "claims.json")).first()["page"] == 2
    files.write_csv(log.select("id", F.array(F.lit("p"), F.lit("q")).alias("l")), str(tmp_path / "out"), one_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["l"] == "p; q"


def make_pdf(text: str) -> bytes:
    import zlib

    content = zlib.compress(f"BT /F1 12 Tf 72 700 Td ({text}) Tj 0 -14 Td [(sec) -20 (ond) -400 (line)] TJ ET".encode("latin-1"))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(content) + content + b"\nendstream", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects)) + b"trailer << /Root 1 0 R >>"


def test_pdf_pages(spark):
    from statweave.operators.pdf import lzw, pdf_pages, run_length

    rows = [("a.pdf", bytearray(make_pdf("Hello \\(w\\351\\) world"))), ("b.pdf", bytearray(b"no"))]
    out = {r["path"]: r for r in pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert out["a.pdf"]["text"] == "Hello (wé) world\nsecond line" and out["b.pdf"]["error"] == "not a PDF file"
    assert run_length(bytes([2, 65, 66, 67, 254, 68, 128])) == b"ABCDDD"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_streams(spark, tmp_path, small):
    from statweave.streaming import provenance

    events = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = provenance.window_counts(stream, "ts", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    q = provenance.latest_records(stream.select("user_id", "event_id"), "user_id", "event_id").writeStream.outputMode("complete").format("memory").queryName("l").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("l").count() == events.select("user_id").distinct().count()
    q = provenance.append(stream.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == events.count()


def test_entity_resolution_query_compares_whole_first_lines(spark, tmp_path):
    from statweave.plans import catalogue

    same = "one long beginning of a first line " * 5
    rows = [(0, f"{same}a\nx", 3), (1, f"{same}b\ny", 3), (2, f"{same}a\nz", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["item_id"]: r["group_id"] for r in catalogue.QUERIES["entity_resolution"](spark, str(tmp_path)).collect()}
    assert got == {"0": "0", "1": "1", "2": "0"}


def test_hits_are_spread_over_pages_before_the_cap(spark):
    pages = spark.createDataFrame([("d", 1, "growth of trade is slow. " * 12), ("d", 2, "growth of trade is slow.")], "doc_id string, page int, text string")
    quotes = spark.createDataFrame([("q", "growth of trade is slow")], "quote_id string, quote string")
    hits = citations.find_quotes(pages, quotes)
    assert sorted(r["page"] for r in hits.collect()) == [1] * 9 + [2]
    exact = citations.exact_hits(pages, quotes).withColumn("tier", F.lit("exact"))
    claims = spark.createDataFrame([("q", "d", 2)], "quote_id string, doc_id string, cited_page int")
    assert citations.verdicts(claims, exact, pages).first()["verdict"] == "FOUND"


def test_a_font_reads_as_its_unicode_map_says():
    from statweave.operators import pdf

    class Document:
        def deep(self, x):
            return x

        def bytes_of(self, stream):
            return stream[1]

    cmap = b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 2 beginbfchar <41> <0058> <8001> <0059> endbfchar"
    font = pdf.Font(Document(), {"Subtype": "Type1", "ToUnicode": ({}, cmap), "Encoding": {"Differences": [65, "g12", "B"]}})
    assert (font.map[65], font.map[66]) == ("X", "B")
    wide = pdf.Font(Document(), {"Subtype": "Type0", "ToUnicode": ({}, cmap), "DescendantFonts": [{}]})
    assert [wide.map[c] for c in wide.codes(b"A\x80\x01A")] == ["X", "Y", "X"]
    assert pdf.Font(Document(), {"Subtype": "Type0", "DescendantFonts": [{}]}).codes(b"\x00A\x00B") == [65, 66]
