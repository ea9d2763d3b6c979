"""Registered queries over payloads and records that are written from the driver's tables, with the SQL they must equal.

Each payload is built by JSON or XML text functions from a table, one message for each nation, customer or part, and
read back by the library's parser; the SQL states the rows straight from the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masks, nested, periods, text
from ..operators import citations, fusion, joins, ranking, tidy
from ..sources import files, payloads
from .catalogue import query, table


def lit(x) -> Column:
    return F.lit(x)


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows


def _by_nation_and_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return x.groupBy("n_nationkey", "n_name", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))


BY_YEAR = "y AS (SELECT n_nationkey, n_name, strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"

# Payloads ---------------------------------------------------------------------------------------------------------


@query(f"WITH {BY_YEAR} SELECT 'X' || n_nationkey AS iso3, n_name AS entity, 'orders' AS indicator, year AS period, CAST(n AS DOUBLE) AS value FROM y WHERE year <> '1995' AND n_nationkey % 7 <> 3")
def envelope_observations(spark, sf_dir):
    """One [meta, rows] message a nation; every fifth nation has no code and takes its aggregate's; some are no economies."""
    y = _by_nation_and_year(spark, sf_dir)
    code = F.concat(lit("X"), F.col("n_nationkey").cast("string"))
    row = F.struct(F.struct(lit("orders").alias("id")).alias("indicator"), F.struct(F.concat(lit("N"), "n_nationkey").alias("id"), F.col("n_name").alias("value")).alias("country"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(code).alias("countryiso3code"), F.col("year").alias("date"), F.when(F.col("year") != "1995", F.col("n").cast("double")).alias("value"))
    bodies = y.groupBy("n_nationkey").agg(F.concat(lit('[{"page":1},'), F.to_json(F.collect_list(row)), lit("]")).alias("body"))
    rows = payloads.envelope(bodies, "struct<indicator:struct<id:string>,country:struct<id:string,value:string>,countryiso3code:string,date:string,value:double>")
    known = table(spark, sf_dir, "nation").select(F.concat(lit("N"), "n_nationkey").alias("iso2"), F.concat(lit("X"), "n_nationkey").alias("iso3"), (F.col("n_nationkey") % 7 == 3).alias("aggregate"))
    return tidy.observations(rows, known, economies_only=True)


@query("SELECT 'X' || n_nationkey AS iso3, 'N' || n_nationkey AS iso2, n_name AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'Aggregates' ELSE r_name END AS region, 'Income ' || n_regionkey AS income, 'Lending' AS lending, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' City' END AS capital, n_nationkey % 6 = 0 AS aggregate FROM nation JOIN region ON n_regionkey = r_regionkey")
def economy_records(spark, sf_dir):
    n = _nations(spark, sf_dir)
    region = F.when(F.col("n_nationkey") % 6 == 0, "Aggregates").otherwise(F.concat(lit(" "), "r_name", lit(" ")))
    row = F.struct(F.concat(lit("X"), "n_nationkey").alias("id"), F.concat(lit("N"), "n_nationkey").alias("iso2Code"), F.concat("n_name", lit(" ")).alias("name"), F.struct(region.alias("value")).alias("region"), F.struct(F.concat(lit("Income "), "n_regionkey").alias("value")).alias("incomeLevel"), F.struct(lit("Lending").alias("value")).alias("lendingType"), F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", lit(" City"))).otherwise("").alias("capitalCity"))
    bodies = n.groupBy("n_regionkey").agg(F.concat(lit("[{},"), F.to_json(F.collect_list(row)), lit("]")).alias("body"))
    one = "struct<value:string>"
    return tidy.economies(payloads.envelope(bodies, f"struct<id:string,iso2Code:string,name:string,region:{one},incomeLevel:{one},lendingType:{one},capitalCity:string>"))


@query("SELECT o_orderstatus AS status, label, priority, year AS period, CAST(n AS VARCHAR) AS value FROM (SELECT o_orderstatus, 'Status ' || o_orderstatus AS label, o_orderpriority AS priority, strftime(o_orderdate, '%Y') AS year, count(*) AS n FROM orders GROUP BY ALL)")
def sdmx_json_series(spark, sf_dir):
    """A message a year: series keys are places in the lists of codes."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))

    def codes(c: str, name: Column) -> DataFrame:
        return o.select(F.col(c).alias("id"), name.alias("name")).distinct()

    lists = {c: codes(c, F.concat(lit("Status "), c) if c == "o_orderstatus" else F.col(c)) for c in ("o_orderstatus", "o_orderpriority")}
    for c, x in lists.items():
        place = F.row_number().over(Window.partitionBy(lit(1)).orderBy("id")) - 1  # a list of a few codes
        o = o.join(F.broadcast(x.select(F.col("id").alias(c), place.cast("string").alias(f"{c}_at"))), c)
    values = [F.broadcast(x.agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias(c))) for c, x in lists.items()]
    series = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "o_orderstatus_at", "o_orderpriority_at").alias("key"), F.struct(F.create_map(lit("0"), F.array(F.col("n").cast("string"))).alias("observations")).alias("value"))))
    m = o.groupBy("year").agg(series.alias("series")).join(values[0], how="cross").join(values[1], how="cross")  # a row each
    dims = F.struct(F.array(F.struct(lit("STATUS").alias("id"), lit(0).alias("keyPosition"), F.col("o_orderstatus").alias("values")), F.struct(lit("PRIORITY").alias("id"), lit(1).alias("keyPosition"), F.col("o_orderpriority").alias("values"))).alias("series"), F.array(F.struct(lit("TIME_PERIOD").alias("id"), F.array(F.struct(F.col("year").alias("id"), F.col("year").alias("name"))).alias("values"))).alias("observation"))
    body = F.to_json(F.struct(F.struct(F.array(F.struct("series")).alias("dataSets"), F.array(F.struct(dims.alias("dimensions"))).alias("structures")).alias("data")))
    out = payloads.sdmx_json(m.select(body.alias("body")))
    return out.select(F.col("dims")["STATUS"].alias("status"), F.col("labels")["STATUS"].alias("label"), F.col("dims")["PRIORITY"].alias("priority"), "period", "value")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyy").alias("year")).agg(F.count("*").alias("n"))


FLAGS = "SELECT l_returnflag AS flag, l_linestatus AS status, strftime(l_shipdate, '%Y') AS period, CAST(count(*) AS VARCHAR) AS value FROM lineitem GROUP BY ALL"


@query(FLAGS)
def sdmx_ml_generic_series(spark, sf_dir):
    def value(k: str, c: str) -> list:
        return [lit(f'<g:Value id="{k}" value="'), c, lit('"/>')]

    obs = F.concat(lit('<g:Obs><g:ObsDimension value="'), "year", lit('"/><g:ObsValue value="'), F.col("n").cast("string"), lit('"/></g:Obs>'))
    series = _flags(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.array_join(F.collect_list(obs), "").alias("obs"))
    one = F.concat(lit("<g:Series><g:SeriesKey>"), *value("FLAG", "l_returnflag"), *value("STATUS", "l_linestatus"), lit("</g:SeriesKey>"), "obs", lit("</g:Series>"))
    bodies = series.groupBy("l_returnflag").agg(F.concat(lit("<m:Data><m:DataSet>"), F.array_join(F.collect_list(one), ""), lit("</m:DataSet></m:Data>")).alias("body"))
    return payloads.sdmx_ml_generic(bodies).select(F.col("dims")["FLAG"].alias("flag"), F.col("dims")["STATUS"].alias("status"), "period", "value")


@query(FLAGS)
def sdmx_ml_specific_series(spark, sf_dir):
    obs = F.concat(lit('<Obs TIME_PERIOD="'), "year", lit('" OBS_VALUE="'), F.col("n").cast("string"), lit('"/>'))
    series = _flags(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(F.array_join(F.collect_list(obs), "").alias("obs"))
    one = F.concat(lit('<Series FLAG="'), "l_returnflag", lit('" STATUS="'), "l_linestatus", lit('">'), "obs", lit("</Series>"))
    bodies = series.groupBy("l_returnflag").agg(F.concat(lit("<m:DataSet>"), F.array_join(F.collect_list(one), "\n"), lit("</m:DataSet>")).alias("body"))
    return payloads.sdmx_ml_specific(bodies).select(F.col("dims")["FLAG"].alias("flag"), F.col("dims")["STATUS"].alias("status"), "period", "value")


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(lit('<s:Code id="'), F.col("n_nationkey").cast("string"), lit('"><c:Name xml:lang="de">x</c:Name><c:Name xml:lang="en">'), "n_name", lit("</c:Name></s:Code>"))
    dim = F.concat(lit('<s:Dimension id="D'), "r_regionkey", lit('" position="2"><Ref id="CL_'), "r_regionkey", lit('" agencyID="A" version="1.0" class="Codelist"/></s:Dimension><s:TimeDimension id="TIME_PERIOD" position="3"></s:TimeDimension>'))
    body = F.concat(lit('<Structure><s:Codelist agencyID="A" id="CL_'), "r_regionkey", lit('" version="1.0">'), F.array_join(F.collect_list(code), ""), lit("</s:Codelist>"), F.first(dim), lit("</Structure>"))
    return _nations(spark, sf_dir).groupBy("r_regionkey").agg(body.alias("body"))


@query("SELECT 'A' AS agency, 'CL_' || n_regionkey AS codelist, '1.0' AS version, CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def structure_codes(spark, sf_dir):
    return payloads.dimension_tables(_structures(spark, sf_dir))[0]


@query("SELECT d.dimension, d.position, d.codelist, d.agency, d.version FROM region, LATERAL (SELECT 'D' || r_regionkey AS dimension, CAST(2 AS BIGINT) AS position, 'CL_' || r_regionkey AS codelist, 'A' AS agency, '1.0' AS version UNION ALL SELECT 'TIME_PERIOD', 3, NULL, NULL, NULL) d")
def structure_dimensions(spark, sf_dir):
    return payloads.dimension_tables(_structures(spark, sf_dir))[1].withColumn("position", F.col("position").cast("long"))


@query("SELECT DISTINCT 'D' || n_regionkey AS dimension, n_name AS code FROM nation UNION ALL SELECT 'ALL', r_name FROM region")
def availability_codes(spark, sf_dir):
    """Constraints that name each code, some of them twice."""
    n = _nations(spark, sf_dir)

    def key(name: Column, c: str) -> Column:
        return F.concat(lit("<s:KeyValue id='"), name, lit("'><c:Value>"), F.array_join(F.collect_list(c), "</c:Value><c:Value> "), lit("</c:Value></s:KeyValue>"))

    cube = F.concat(lit("<s:CubeRegion>"), key(F.concat(lit("D"), F.first("r_regionkey").cast("string")), "n_name"), key(lit("ALL"), "r_name"), lit("</s:CubeRegion>"))
    return payloads.constraint_codes(n.groupBy("n_regionkey").agg(cube.alias("body")))


@query("SELECT '2101.' || p_partkey AS id, p_name AS title, p_type AS abstract, '2021-03-04' AS date, p_brand || ';' || p_type AS authors, '10.48550/arxiv.2101.' || p_partkey AS doi FROM part")
def atom_entries(spark, sf_dir):
    p = table(spark, sf_dir, "part")

    def tag(name: str, c) -> list:
        return [lit(f"<{name}>"), c, lit(f"</{name}>")]

    entry = F.concat(lit("<entry>"), *tag("id", F.concat(lit("http://a.org/abs/2101."), F.col("p_partkey").cast("string"), lit("v2"))), *tag("title", F.replace("p_name", lit(" "), lit(" \n "))), *tag("summary", "p_type"), *tag("published", lit("2021-03-04T00:00:00Z")), *tag("author", F.concat(*tag("name", "p_brand"))), *tag("author", F.concat(*tag("name", "p_type"))), lit('<category term="econ"/></entry>'))
    bodies = p.groupBy("p_brand").agg(F.concat(lit("<feed>"), F.array_join(F.collect_list(entry), ""), lit("</feed>")).alias("body"))
    return payloads.atom_items(bodies).select("id", "title", "abstract", "date", F.array_join("authors", ";").alias("authors"), "doi")


@query("SELECT o_custkey, CASE WHEN o_custkey % 3 = 2 THEN CAST(n AS VARCHAR) ELSE ks END AS packed FROM (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) AS ks FROM orders GROUP BY o_custkey)")
def packed_lists(spark, sf_dir):
    """Lists as objects of numbered entries, as arrays, or as a bare value."""
    keys = F.array_sort(F.collect_list("o_orderkey"))
    x = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(keys, lambda k: k.cast("string")).alias("k"))
    as_object = F.to_json(F.map_from_entries(F.transform("k", lambda v, i: F.struct(i.cast("string"), v))))
    body = F.when(F.col("o_custkey") % 3 == 0, as_object).when(F.col("o_custkey") % 3 == 1, F.to_json("k")).otherwise(F.size("k").cast("string"))
    return x.select("o_custkey", F.array_join(nested.packed_list(body), "|").alias("packed"))


@query("WITH t(id, parent, name, dataset) AS (SELECT 'r' || r_regionkey, NULL, r_name, NULL FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'd' || n_nationkey END FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name, 'd' || (s_suppkey % 60 + 100) FROM supplier) SELECT dataset, min(path) AS path FROM (SELECT t.dataset, r.name || ' / ' || t.name AS path FROM t JOIN t r ON t.parent = r.id AND r.parent IS NULL WHERE t.dataset IS NOT NULL UNION ALL SELECT t.dataset, r.name || ' / ' || n.name || ' / ' || t.name FROM t JOIN t n ON t.parent = n.id JOIN t r ON n.parent = r.id) GROUP BY dataset")
def category_tree_leaves(spark, sf_dir):
    def s(c: str, k: str) -> Column:
        return F.concat(lit(c), F.col(k).cast("string"))

    none = lit(None).cast("string")
    r = table(spark, sf_dir, "region").select(s("r", "r_regionkey").alias("id"), none.alias("parent"), F.col("r_name").alias("name"), none.alias("dataset"))
    n = table(spark, sf_dir, "nation").select(s("n", "n_nationkey"), s("r", "n_regionkey"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, s("d", "n_nationkey")))
    leaf = table(spark, sf_dir, "supplier").select(s("s", "s_suppkey"), s("n", "s_nationkey"), "s_name", F.concat(lit("d"), (F.col("s_suppkey") % 60 + 100).cast("string")))
    return payloads.category_leaves(r.union(n).union(leaf))


# Projections of nested records ------------------------------------------------------------------------------------


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ': ' || p_type WHEN p_partkey % 3 = 1 THEN p_name ELSE p_brand END AS title, '10.1596/' || p_partkey AS doi, p_brand || '|' || p_type AS authors FROM part")
def report_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    docs = p.select(F.col("p_partkey").cast("string").alias("id"), "p_name", k.alias("k"), "p_brand", "p_type", "p_type")
    docs = docs.select("id", F.when(F.col("k") < 2, F.col("p_name")).otherwise("").alias("display_title"), F.struct(F.col("p_brand").alias("repnme")).alias("repnme"), F.create_map(lit("0"), F.struct(F.when(F.col("k") == 0, F.concat("p_name", lit(": "), "p_type")).alias("docna"))).alias("docna"), F.concat(lit("https://doi.org/10.1596/"), "id", lit("; 10.1/x")).alias("dois"), lit("2020-01-01").alias("docdt"), lit("Report").alias("docty"), lit("1").alias("repnb"), lit("g").alias("guid"), F.create_map(lit("0"), F.struct(F.col("p_brand").alias("author")), lit("1"), F.struct(F.col("p_type").alias("author"))).alias("authors"), lit("u").alias("pdfurl"), lit("u").alias("url"))
    return tidy.report_documents(docs).select("id", "title", "doi", F.array_join("authors", "|").alias("authors"))


@query("SELECT p_partkey AS uuid, CASE WHEN p_partkey % 2 = 0 THEN p_name || ': ' || p_type ELSE p_name END AS title, p_type AS type, p_brand AS authors, CAST(p_partkey % 3 AS INTEGER) AS pdfs FROM part")
def repository_records(spark, sf_dir):
    def values(*cs) -> Column:
        return F.array(*[F.struct((lit(c) if c == "" else F.col(c)).alias("value")) for c in cs])

    p = table(spark, sf_dir, "part").withColumn("kind", F.concat(lit("Publications::"), "p_type")).withColumn("sub", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.element_at(F.split("p_name", " "), 1)))
    meta = F.create_map(lit("dc.title"), values("p_name"), lit("okr.title.subtitle"), values("sub"), lit("okr.doctype"), values("kind"), lit("dc.contributor.author"), values("p_brand", "", "p_brand"))
    files_ = F.transform(F.slice(F.array(lit("a.PDF"), lit("b.pdf")), lit(1), (F.col("p_partkey") % 3).cast("int")), lambda f: F.struct(f.alias("name")))
    bundles = F.array(F.struct(lit("ORIGINAL").alias("name"), F.concat(files_, F.array(F.struct(lit("c.txt").alias("name")))).alias("bitstreams")), F.struct(lit("TEXT").alias("name"), F.array(F.struct(lit("d.pdf").alias("name"))).alias("bitstreams")))
    out = tidy.repository_items(p.select(F.col("p_partkey").alias("uuid"), lit("h").alias("handle"), meta.alias("metadata"), bundles.alias("bundles")))
    return out.select("uuid", "title", "type", F.array_join("authors", ";").alias("authors"), F.size("pdfs").alias("pdfs"))


@query("SELECT p_partkey AS id, p_brand || CASE WHEN p_size % 2 = 0 THEN ' (' || p_size || '%)' ELSE '' END AS sectors, p_type AS themes, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS BIGINT) ELSE nullif(CAST(p_partkey AS BIGINT), 0) END AS amount FROM part")
def project_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sector = F.struct(F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("percent"))
    first = F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("long")).otherwise(F.when(F.col("p_size") % 2 == 0, lit(0)))
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(sector, sector).alias("sectors"), F.array("p_type", "p_type").alias("themes"), first.cast("long").alias("commitment"), lit(0).cast("long").alias("current_amount"), F.col("p_partkey").cast("long").alias("grant_amount"), lit("Active").alias("status"))
    return tidy.projects(rows).select("id", F.array_join("sectors", "|").alias("sectors"), F.array_join("themes", "|").alias("themes"), "amount")


@query(f"WITH {BY_YEAR} SELECT 'a,b' AS indicator, year AS period, CAST(n AS VARCHAR) AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'M' END AS Sex, 'one | two' AS footnotes, CASE WHEN n_nationkey < 20 THEN n_name END AS iso3 FROM y")
def goal_records(spark, sf_dir):
    y = _by_nation_and_year(spark, sf_dir)
    rows = y.select(F.array(lit("a"), lit("b")).alias("indicator"), lit("s").alias("series"), F.col("n_nationkey").cast("string").alias("geoAreaCode"), F.col("n_name").alias("geoAreaName"), F.col("year").alias("timePeriodStart"), F.col("n").cast("string").alias("value"), F.when(F.col("n_nationkey") % 2 == 0, F.create_map(lit("Sex"), lit("M"))).otherwise(F.create_map(lit("Age"), lit("x"))).alias("dimensions"), F.array(lit("one"), lit(""), lit("two")).alias("footnotes"))
    areas = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("m49"), F.col("n_name").alias("iso3"))
    return tidy.goal_observations(rows, ["Sex"], areas).select("indicator", F.col("timePeriodStart").alias("period"), "value", "Sex", "footnotes", "iso3")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, c_custkey AS key FROM customer")
def displacement_records(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "-").otherwise(F.col("c_mktsegment")).alias("segment"), "c_name")
    return tidy.displacement_rows(c, ["segment", "key"])


@query("SELECT p_partkey AS id, '10.1/' || p_partkey AS doi, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'best' WHEN p_partkey % 3 = 1 THEN 'third' ELSE 'http://a/x.pdf' END AS pdf_url, p_brand AS institutions, p_name AS abstract FROM part")
def work_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    link = "struct<pdf_url:string>"
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(lit("DOI:10.1/"), "p_partkey").alias("doi"), F.concat(lit("<i>"), "p_name", lit("</i>")).alias("title"), lit(2020).alias("publication_year"), F.when(k == 0, F.struct(lit("best").alias("pdf_url"))).cast(link).alias("best_oa_location"), lit(None).cast(link).alias("primary_location"), F.array(F.struct(lit(None).cast("string").alias("pdf_url")), F.struct(F.when(k == 1, "third").alias("pdf_url"))).alias("locations"), F.struct(lit("http://a/x.pdf").alias("oa_url")).alias("open_access"), F.array("p_brand", "p_brand").alias("institutions"), nested.inverted_index(F.col("p_name")).alias("abstract_inverted_index"), lit(1).alias("cited_by_count"))
    return tidy.works(rows).select("id", "doi", "title", "pdf_url", F.array_join("institutions", ";").alias("institutions"), "abstract")


@query("SELECT '10.2/' || p_partkey AS doi, p_name || ': ' || p_type AS title, p_brand || '; A B' AS authors, '2021-0' || (1 + p_partkey % 9) AS date, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'Inst' END AS venue FROM part")
def registry_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    none = lit(None).cast("string")
    rows = p.select(F.concat(lit("10.2/"), "p_partkey").alias("DOI"), F.array("p_name").alias("title"), F.array("p_type").alias("subtitle"), F.array(F.struct(F.col("p_brand").alias("name"), none.alias("given"), none.alias("family")), F.struct(none.alias("name"), lit("A").alias("given"), lit("B").alias("family"))).alias("author"), F.array(F.array(lit(2021), (1 + F.col("p_partkey") % 9).cast("int"))).alias("issued"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("container"), lit("Inst").alias("institution"), lit("Pub").alias("publisher"))
    return tidy.registered_works(rows).select("doi", "title", F.array_join("authors", "; ").alias("authors"), "date", "venue")


@query("SELECT 'Y.' || l_returnflag || '.' || l_linestatus AS series_key, l_returnflag AS entity, 'Y' AS frequency, l_linestatus AS indicator, strftime(l_shipdate, '%Y') AS period, count(*) AS value, 'items' AS unit, CASE WHEN l_linestatus = 'F' THEN 'final' ELSE 'A' END AS status FROM lineitem GROUP BY ALL")
def series_observation_rows(spark, sf_dir):
    dims = F.create_map(lit("FREQ"), lit("Y"), lit("AREA"), F.col("l_returnflag"), lit("ITEM"), F.col("l_linestatus"))
    attrs = F.when(F.col("l_linestatus") == "F", F.create_map(lit("UNIT"), lit("items"), lit("DERIVATION_TYPE"), lit("final"), lit("OBS_STATUS"), lit("A"))).otherwise(F.create_map(lit("UNIT"), lit("items"), lit("OBS_STATUS"), lit("A")))
    rows = _flags(spark, sf_dir).select(dims.alias("dims"), attrs.alias("attrs"), F.col("year").alias("period"), F.col("n").alias("value"))
    return tidy.series_rows(rows, ["FREQ", "AREA", "ITEM"], ["COUNTRY", "AREA"], ["FREQ"])


@query("SELECT 'wds:' || p_partkey AS id, p_brand || CASE WHEN p_size % 2 = 0 THEN '; ' || p_type ELSE '' END AS notes, p_name AS title FROM part")
def source_records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return tidy.records(p, "wds", "p_partkey", [F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))], title=F.col("p_name"))


# Filters and joins ------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, lower(p_brand) = 'brand#1' AS by_id, p_size >= 10 AND p_size <= 20 AND p_brand IN ('Brand#1', 'Brand#2') AS conjunction, 'p_brand eq ''Brand#1'' or p_brand eq ''Brand#2''' AS clause, p_partkey % 3 <> 0 AS lands, p_partkey % 4 IN (0, 1) AS in_series, p_partkey % 5 <> 0 AS has_data FROM part WHERE lower(p_brand) = 'brand#1' OR contains(lower(p_name), 'ring') OR p_size < 25")
def record_predicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    both, words = masks.odata_filter({"p_brand": ["Brand#1", "Brand#2"]}, {"p_size": 10}, {"p_size": 20})
    urls = F.when(F.col("p_partkey") % 3 != 0, F.array(lit("http://x/y"), lit("https://open.org/z"))).otherwise(F.array(lit("http://x/y")))
    doi = F.when(F.col("p_partkey") % 4 == 0, lit("10.1596/a")).otherwise(lit("10.9/b"))
    boxes = F.when(F.col("p_partkey") % 4 == 1, F.array(lit("Series"))).otherwise(F.array(lit("Other")))
    flag = F.when(F.col("p_partkey") % 5 == 0, lit(False)).when(F.col("p_partkey") % 5 == 1, lit(True))
    clause = F.regexp_extract(lit(words), r"\(([^)]*)\)", 1)
    kept = p.where(masks.id_or_name(F.col("p_brand"), F.col("p_name"), ["BRAND#1", "Ring"]) | (F.col("p_size") < 25))
    return kept.select("p_partkey", masks.id_or_name(F.col("p_brand"), lit(""), ["Brand#1"]).alias("by_id"), both.alias("conjunction"), clause.alias("clause"), masks.lands_on(urls, "open.org").alias("lands"), masks.in_series(doi, boxes, prefix="10.1596/", container="Series").alias("in_series"), masks.has_data(flag).alias("has_data"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'by version' WHEN n_nationkey % 3 = 1 THEN 'by agency' WHEN n_nationkey % 6 = 2 THEN 'by id' END AS label, coalesce(r_name, '') AS region FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 4) ON n_regionkey = r_regionkey")
def codelist_resolution(spark, sf_dir):
    """A label by agency, id and version, else by agency and id, else by id alone; a region's name or nothing."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey"), lit("A").alias("agency"), F.col("n_nationkey").alias("id"), lit("2").alias("version"))
    k = F.col("id") % 3
    lists = n.select(F.when(k == 2, "B").otherwise("A").alias("agency"), "id", F.when(k == 0, "2").otherwise("1").alias("version"), F.when(k == 0, "by version").when(k == 1, "by agency").when(F.col("id") % 6 == 2, "by id").alias("label"))
    out = joins.with_fallback(n, lists, [["agency", "id", "version"], ["agency", "id"], ["id"]], "label")
    regions = table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    return joins.label(out, regions, "n_regionkey", "region").select("n_nationkey", "label", "region")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE coalesce(f.folder, 'default') END AS folder FROM customer LEFT JOIN (SELECT o_custkey, 'f' || min(o_orderkey) AS folder FROM orders GROUP BY o_custkey) f ON c_custkey = o_custkey")
def claim_text_folders(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 3 == 0, "own").when(F.col("c_custkey") % 3 == 1, "").alias("text"))
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.concat(lit("f"), F.min("o_orderkey").cast("string")).alias("folder"))
    return joins.claim_folders(claims, first, "default").select("c_custkey", "folder")


@query("SELECT p.p_partkey, CASE WHEN p.p_partkey % 2 = 0 THEN 'id' || p.p_partkey ELSE 'id' || q.p_partkey END AS record_id FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey - 1")
def logged_source_records(spark, sf_dir):
    """Records of even parts, logged twice; odd parts are found by the address of the part before, in another spelling."""
    p = table(spark, sf_dir, "part")
    even = p.where("p_partkey % 2 = 0")
    url = F.concat(lit("http://Documents1.Example.org/x"), (F.col("p_partkey")).cast("string"))
    base = even.select(F.concat(lit("id"), "p_partkey").alias("id"), url.alias("url"), (F.col("p_partkey") * 2).alias("seq"))
    log = base.select("id", lit("http://old/").alias("url"), lit(None).cast("string").alias("pdf_url"), "seq").unionByName(base.select("id", lit(None).cast("string").alias("url"), F.col("url").alias("pdf_url"), (F.col("seq") + 1).alias("seq")))
    k = F.col("p_partkey")
    docs = p.select("p_partkey", F.when(k % 2 == 0, F.concat(lit("id"), k.cast("string"))).alias("source_id"), F.concat(lit("https://documents.example.org/x"), (k - 1).cast("string"), lit("/?q=1")).alias("url"))
    return joins.logged_source(docs, log).select("p_partkey", "record_id")


@query("SELECT l_orderkey AS source, l_partkey AS target, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 2")
def citation_neighbours(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.when(F.col("l_linenumber") != 2, F.col("l_partkey")).alias("target"))
    works = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return joins.neighbours(edges, works).select("source", "target", "p_name")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def codes_in_use(spark, sf_dir):
    codes = table(spark, sf_dir, "nation").select("n_nationkey")
    return joins.in_use(codes, table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"]).select("n_nationkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def current_reporter(spark, sf_dir):
    entries = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(lit("x"), (F.col("n_nationkey") % 20).cast("string")).alias("iso"), (F.col("n_nationkey") > 20).alias("expired"))
    return joins.current_entry(entries, "n_nationkey", "nobody", "X7", "iso", "n_name").select("n_nationkey", "n_name")


@query("SELECT p_partkey AS code FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, length(p_name), p_partkey) AS n FROM part) WHERE n <= 40")
def dotted_code_order(spark, sf_dir):
    dots = F.element_at(F.array(lit(""), lit("."), lit("..")), (F.col("p_size") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select(F.concat(dots, F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("code"), "p_name", "p_partkey")
    return tidy.dotted_order(p, "code", "p_name").limit(40).select(F.col("p_partkey").alias("code"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_size > 25 THEN '' ELSE CAST(p_size AS VARCHAR) END, CAST(p_partkey AS VARCHAR)) AS place FROM part")
def sorted_as_text(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") <= 25, F.col("p_size")).alias("size"))
    return ranking.rank(tidy.sort_as_text(p, ["size", "p_partkey"]), F.coalesce(F.col("size").cast("string"), lit("")), F.col("p_partkey").cast("string")).select("p_partkey", F.col("rank").cast("long").alias("place"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a price as items of two sources that share a DOI for every third part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")

    def one(name: str, order: int) -> DataFrame:
        return p.select(lit(name).alias("source"), lit(order).alias("source_order"), (k % 50 + 1).cast("int").alias("rank"), F.concat(lit("10.5/"), F.when((k % 3 == 0) | lit(order == 0), k).otherwise(-k).cast("string")).alias("doi"), F.concat("p_name", lit(f" {name} "), k.cast("string")).alias("title"), lit(2020).alias("year"), F.when(lit(order == 1), F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("authors"), F.when(lit(order == 1), F.col("p_type")).otherwise("").alias("abstract"), F.when(lit(order == 1), F.col("p_size")).otherwise(1).cast("int").alias("cited_by"), lit(order == 1).alias("is_oa"), F.concat(lit(name), k.cast("string")).alias("item_id"))

    return one("a", 0).unionByName(one("b", 1))


@query("SELECT '10.5/' || p_partkey AS doi, 'a' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN ',b' || p_partkey ELSE '' END AS item_ids, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS abstract, CAST(CASE WHEN p_partkey % 3 = 0 THEN greatest(p_size, 1) ELSE 1 END AS INTEGER) AS cited_by, p_partkey % 3 = 0 AS is_oa, round(CASE WHEN p_partkey % 3 = 0 THEN 2.0 ELSE 1.0 END / (61 + p_partkey % 50), 9) AS rrf FROM part UNION ALL SELECT '10.5/-' || p_partkey, 'b' || p_partkey, p_type, CAST(p_size AS INTEGER), true, round(1.0 / (61 + p_partkey % 50), 9) FROM part WHERE p_partkey % 3 <> 0")
def merged_items(spark, sf_dir):
    """Items of two sources: those with one DOI are one work, with the first non-empty fields in source order."""
    items = _items(spark, sf_dir)
    out = fusion.best_of_group(items, fusion.resolve(items))
    return out.select("doi", F.array_join("item_ids", ",").alias("item_ids"), "abstract", "cited_by", "is_oa", F.round("rrf", 9).alias("rrf"))


@query("SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def union_of_code_sets(spark, sf_dir):
    """The codes that either of two constraints allows."""
    o = table(spark, sf_dir, "orders")
    sets = [o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(s)) for s in ("F", "O")]
    both = joins.union_of_codes(sets[0], sets[1], "o_custkey", "F", "O", "codes")
    return both.select("o_custkey", F.size("codes").cast("long").alias("n"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS first_value FROM orders GROUP BY o_custkey")
def first_seen_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(nested.first_seen(F.col("o_orderkey"), F.col("o_orderpriority")).alias("v"))
    return o.select("o_custkey", F.get("v", lit(0)).alias("first_value"))


@query("SELECT c_nationkey AS country, o_orderpriority AS indicator, strftime(max(o_orderdate), '%Y') AS latest_actual FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def latest_actual_periods(spark, sf_dir):
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = x.select(F.col("c_nationkey").alias("country"), F.col("o_orderpriority").alias("indicator"), F.date_format("o_orderdate", "yyyy").alias("period"), (F.col("o_orderstatus") == "F").alias("actual"))
    return ranking.latest_actual(rows, ["country", "indicator"], "period", F.col("actual"))


@query("SELECT p_brand, p_size, p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') QUALIFY p_size = max(p_size) OVER (PARTITION BY p_brand)")
def newest_vintage_of_agency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    return ranking.vintage(p, "p_brand", ["Brand#1", "Brand#2"], "p_size")


# Text, periods and logs -------------------------------------------------------------------------------------------


@query("SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^<>]{1,200}>', ' ', 'g'), '\\s+', ' ', 'g')), 300) AS snippet FROM pages")
def html_snippets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.snippet(F.col("html")).alias("snippet"))


@query("SELECT c_custkey, 'van Smith' || c_custkey AS one, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'van Smith' || c_custkey WHEN 2 THEN 'van Smith' || c_custkey || ' and Doe' ELSE 'van Smith' || c_custkey || ' et al.' END AS label FROM customer")
def author_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    name = F.concat(lit("Ann  B. van Smith"), F.col("c_custkey").cast("string"))
    all_ = F.array(name, lit("Doe, John"), lit("X Y"))
    return c.select("c_custkey", text.surname(name).alias("one"), text.author_label(F.slice(all_, lit(1), (F.col("c_custkey") % 4).cast("int"))).alias("label"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'doi' WHEN 1 THEN 'openalex' WHEN 2 THEN 'arxiv' WHEN 3 THEN 'document' WHEN 4 THEN 's2' ELSE 'report' END AS kind, 'https://www.worldbank.org/' || c_custkey AS url, c_mktsegment || '|x' || c_custkey || '|latest' AS flow, 'p|d|s/' || c_custkey AS series, 'a|b' AS parts, 'O''''Neil' || c_custkey AS quoted, CASE WHEN c_custkey = 1 THEN '1 row' ELSE format('{:,}', c_custkey) || ' rows' END AS counted FROM customer")
def identifier_routes(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    kind = F.element_at(F.array(F.concat(lit("https://doi.org/10.1234/"), k), F.concat(lit("W"), k), lit("arXiv:2101.00001v2"), F.concat(lit("D"), k), F.repeat(lit("0a"), lit(20)), F.concat(lit("Report "), k)), (F.col("c_custkey") % 6 + 1).cast("int"))
    flow, parts = text.split_flow(F.concat("c_mktsegment", lit(",x"), k)), text.split_series_id(F.concat(lit("p/d/s/"), k))
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.id_kind(kind).alias("kind"), text.https_upgrade(F.concat(lit("http://www.worldbank.org/"), k)).alias("url"), F.concat_ws("|", flow["agency"], flow["id"], flow["version"]).alias("flow"), F.concat_ws("|", parts["provider"], parts["dataset"], parts["series"]).alias("series"), F.array_join(text.split_values(lit(" a,, b ")), "|").alias("parts"), F.regexp_replace(text.odata_quote(F.concat(lit("O'Neil"), k)), "^'|'$", "").alias("quoted"), text.plural(F.col("c_custkey"), "row").alias("counted"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_partkey AS stem, CASE WHEN p_partkey % 3 = 0 THEN 'EL' WHEN p_partkey % 3 = 1 THEN 'EU27' ELSE 'FR' END AS geo, 'q | size=' || p_size AS label, CASE WHEN p_partkey % 2 = 0 THEN 'use the library' END AS hint, CASE WHEN p_size = 1 THEN 'one' WHEN p_size = 2 THEN 'two' END AS mapped FROM part")
def names_and_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    token = F.when(k % 3 == 0, "gr").when(k % 3 == 1, "eu27").otherwise("fra")
    iso2 = F.when(k % 3 == 0, "GR").when(k % 3 == 2, "FR")
    return p.select("p_partkey", text.safe_name(F.concat("p_name", lit(" / "), k.cast("string"), lit("."))).alias("stem"), text.to_geo(token, iso2).alias("geo"), text.labelled_query(lit("q"), {"size": F.col("p_size").cast("string"), "none": lit("")}).alias("label"), text.hint(F.when(k % 2 == 0, "10.5/x").otherwise("10.6/x"), {"10.5/": "use the library"}).alias("hint"), text.mapped(F.col("p_size"), {1: "one", 2: "two"}).alias("mapped"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(year(o_orderdate) AS INTEGER) AS found, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') || '-2030' WHEN 1 THEN 'from' || strftime(o_orderdate, '%Y') WHEN 2 THEN 'to2030' ELSE 'last5' END AS tag, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders")
def period_parts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    tag = periods.period_tag(F.when(k < 2, F.left(day, lit(4))), F.when(k % 2 == 0, lit("2030")), lit(5))
    return o.select("o_orderkey", periods.iso_date(F.concat(day, lit("T00:00:00Z"))).alias("day"), periods.iso_year(day).alias("year"), periods.year_in_text(F.concat(lit("in 99 and "), F.left(day, lit(4)), lit("."))).alias("found"), periods.iso_month(F.date_format("o_orderdate", "MMMM yyyy")).alias("month"), F.date_format(periods.last_day_of(day), "yyyy-MM-dd").alias("last_day"), tag.alias("tag"), periods.amount(F.col("o_totalprice")).alias("amount"))


@query("SELECT n_nationkey, n_name AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 'Q' ELSE 'A' END AS frequency, 'en ' || n_name AS english, 'first,second' AS metadata, CAST(CASE WHEN n_nationkey = 0 THEN 5 ELSE n_nationkey END AS BIGINT) AS amount FROM nation")
def nested_record_parts(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    dims = F.create_map(lit("FREQ"), lit("A"), lit("Item"), lit("x"), lit("geo_unit"), F.col("n_name"))
    names = F.array(F.struct(lit("de").alias("lang"), lit("x").alias("text")), F.struct(lit("en-GB").alias("lang"), F.concat(lit("en "), "n_name").alias("text")))
    meta = F.create_map(lit("a"), F.array(F.struct(lit("first").alias("value")), F.struct(lit("").alias("value"))), lit("b"), F.array(F.struct(lit("second").alias("value")), F.struct(lit("first").alias("value"))))
    return n.select("n_nationkey", nested.entity_of(dims).alias("entity"), nested.frequency_of(F.when(F.col("n_nationkey") % 2 == 0, "Q"), dims).alias("frequency"), nested.english(names).alias("english"), F.array_join(nested.all_metadata(meta, "a", "b", "c"), ",").alias("metadata"), nested.headline_amount(F.col("n_nationkey").cast("long"), lit(None).cast("long"), lit(5).cast("long")).alias("amount"))


@query("SELECT p_partkey, '(' || p_name || ', 2020, ' || CASE WHEN p_size % 2 = 0 THEN 'p. 3' ELSE 'pp. 3-' || (p_size + 3) END || ') http://a/x.pdf#page=3' AS cited, '(orders, ' || p_type || ', ' || p_brand || ', 2020, retrieved 2024-01-02, u)' AS line FROM part")
def citation_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    pages = F.when(F.col("p_size") % 2 == 0, F.array(lit(3), lit(3))).otherwise(F.array(F.col("p_size").cast("int") + 3, lit(3)))
    return p.select("p_partkey", citations.citation(pages, F.col("p_name"), lit(2020), lit("http://a/x.pdf")).alias("cited"), files.citation_line(lit("orders"), F.col("p_type"), F.col("p_brand"), lit("2020"), lit("2024-01-02"), lit("u")).alias("line"))


@query("SELECT doc_id, page, CAST(instr(t, 'the') - 1 AS BIGINT) AS start, 'the' AS matched FROM (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS BIGINT) AS page, unnest(string_split(text, chr(10))) AS t FROM documents) WHERE contains(t, 'the')")
def short_quote_hits(spark, sf_dir):
    """A quote of one word has no word inside; it meets pages by its letters."""
    from .catalogue import _doc_pages

    pages = _doc_pages(spark, sf_dir)
    quotes = spark.createDataFrame([(1, "the")], "quote_id int, quote string")
    hits = citations.exact_hits(pages, quotes).groupBy("doc_id", "page").agg(F.min("start").alias("start"), F.min("end").alias("end"))
    met = citations.with_context(hits, pages)
    return met.select("doc_id", F.col("page").cast("long").alias("page"), F.col("start").cast("long").alias("start"), F.col("matched_text").alias("matched"))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS copies FROM documents")
def log_without_repeats(spark, sf_dir):
    """A log that was appended twice, read as the last record of each id."""
    from ..streaming import provenance

    log = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), lit(1).alias("seq"))
    both = log.unionByName(log.withColumn("seq", lit(2)))
    return provenance.latest_records(both, "id", "seq").groupBy(F.col("id").alias("doc_id")).agg((F.count("*") - 1).alias("copies"))
