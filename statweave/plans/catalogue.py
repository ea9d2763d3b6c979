"""Registered queries: each applies an operator of the library to the driver's tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import masks, nested, periods, text
from ..operators import citations, fusion, joins, ranking, tidy
from ..streaming import provenance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations: nation as the entity, month as the period; totals under 30,000 count as missing."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # 25 nations
    return joined.select(F.col("n_name").alias("entity"), F.date_format("o_orderdate", "yyyy-MM").alias("period"), F.when(F.col("o_totalprice") >= 30000, F.col("o_totalprice")).alias("value"), "o_orderkey")


ORDERS = """obs AS (SELECT n_name AS entity, strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN o_totalprice >= 30000 THEN o_totalprice END AS value, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
series AS (SELECT entity, period, round(sum(value), 2) AS value, count(value) AS n FROM obs GROUP BY entity, period)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).groupBy("entity", "period").agg(F.round(F.sum("value"), 2).alias("value"), F.count("value").alias("n"))


# Tidy rows, filters, facets ---------------------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT entity, period, n FROM series WHERE value IS NOT NULL")
def tidy_observations(spark, sf_dir):
    return tidy.drop_missing(_series(spark, sf_dir), "value").select("entity", "period", "n").orderBy("entity", "period")


@query("SELECT p_partkey, p_brand || '.' || p_type || '.' || p_size AS series_key FROM part WHERE p_brand IN ('Brand#1', 'Brand#3') AND p_size IN (10, 11, 12)")
def series_mask_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    keep = masks.series_mask([F.col("p_brand"), F.col("p_type"), F.col("size")], "Brand#1+Brand#3..10+11+12")
    dims = F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type", F.lit("size"), "size")
    return part.where(keep).select("p_partkey", nested.series_key(dims, ["brand", "type", "size"]).alias("series_key"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus IN ('F')")
def dimension_filter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    keep = masks.dimension_filter({"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}, ["L_RETURNFLAG=A,R", "l_linestatus=F"])
    return li.where(keep).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small')")
def keyword_all_words(spark, sf_dir):
    return table(spark, sf_dir, "part").where(masks.all_words(F.col("p_name"), "Ring small")).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])onth') AND regexp_matches(lower(text), '(^|[^a-z0-9])the')")
def keyword_word_start(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(masks.word_starts(F.col("text"), ["onth", "the"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)')")
def keyword_whole_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(masks.whole_words(F.col("text"), ["license"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (contains(lower(text), 'under the') AND contains(lower(text), 'license')) OR contains(lower(text), 'idiot')")
def boolean_text_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(masks.boolean_query(F.col("text"), '"under the" license OR idiot')).select("doc_id")


@query("SELECT p_partkey, name_match FROM (SELECT p_partkey, contains(lower(p_name), 'ring') AS name_match FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring') OR contains(lower(p_type), 'econ') ORDER BY name_match DESC, p_size = 2 DESC, length(p_name), p_partkey LIMIT 50)")
def catalogue_relevance_top(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hits = part.where(masks.all_words(F.concat_ws(" ", "p_name", "p_type"), "ring") | masks.all_words(F.col("p_type"), "econ")).withColumn("name_match", F.contains(F.lower("p_name"), F.lit("ring")))
    return tidy.catalogue_order(hits, F.col("name_match"), F.col("p_size") == 2, "p_name", "p_partkey").limit(50).select("p_partkey", "name_match")


@query("SELECT event_id FROM events WHERE (year(ts) BETWEEN 2024 AND 2024 OR ts IS NULL) AND event_type IN ('click', 'view')")
def year_range_keeps_null(spark, sf_dir):
    return table(spark, sf_dir, "events").where(masks.in_years(F.year("ts"), 2024, 2024) & masks.multi_value(F.col("event_type"), "click;view")).select("event_id")


@query("SELECT o_custkey, CASE WHEN min(d) = max(d) THEN min(d) ELSE min(d) || ':' || max(d) END AS period FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS d FROM orders) GROUP BY o_custkey")
def period_range_by_series(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(periods.period_range(F.date_format("o_orderdate", "yyyy-MM")).alias("period"))


@query(f"WITH {ORDERS} SELECT entity, count(*) AS n, min(period) AS first_period, max(period) AS last_period, max(period) FILTER (value IS NOT NULL) AS last_available FROM series GROUP BY entity")
def series_summary(spark, sf_dir):
    return tidy.series_summary(_series(spark, sf_dir), ["entity"], "period", "value")


@query("SELECT 'lang' AS dimension, lang AS code, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_counts(spark, sf_dir):
    return tidy.facet_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT 'lang' AS dimension, lang AS code, count(*) AS n FROM documents WHERE source IN ('src1', 'src2') GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang IN ('en') GROUP BY source")
def facet_counts_other_filters(spark, sf_dir):
    return tidy.facets_with_filters(table(spark, sf_dir, "documents"), ["lang", "source"], {"lang": ["en"], "source": ["src1", "src2"]})


@query("SELECT coalesce(l_returnflag, '_T') AS flag, coalesce(l_linestatus, '_T') AS status, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def totals_rollup(spark, sf_dir):
    cube = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))
    return cube.select(F.coalesce("l_returnflag", F.lit("_T")).alias("flag"), F.coalesce("l_linestatus", F.lit("_T")).alias("status"), "quantity", "n")


@query("SELECT CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem")
def totals_only(spark, sf_dir):
    return tidy.only_totals(totals_rollup(spark, sf_dir).withColumn("kind", F.lit("x")), {"flag": ["_T"], "status": ["_T"], "kind": ["_T"]}).select("quantity", "n")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 0")
def compact_view(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).withColumn("unit", F.lit("orders"))
    return tidy.compact_columns(counts)[0]


# Order-dependent operators ----------------------------------------------------------------------------------------


@query(f"WITH {ORDERS} SELECT entity, period, n FROM series WHERE period IN (SELECT DISTINCT period FROM series WHERE value IS NOT NULL ORDER BY period DESC LIMIT 3)")
def latest_n_per_request(spark, sf_dir):
    return ranking.latest_for_request(_series(spark, sf_dir), "period", "value", 3).select("entity", "period", "n")


@query(f"WITH {ORDERS}, latest AS (SELECT entity, period, n FROM series WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY period DESC) <= 5) SELECT entity, count(*) AS n_periods, min(period) || ':' || max(period) AS period, CAST(sum(n) AS BIGINT) AS n FROM latest GROUP BY entity")
def latest_n_nonempty_per_entity(spark, sf_dir):
    latest = ranking.latest_nonempty(_series(spark, sf_dir), ["entity"], "period", "value", 5)
    return latest.groupBy("entity").agg(F.count("*").alias("n_periods"), periods.period_range(F.col("period")).alias("period"), F.sum("n").alias("n"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def last_n_observations(spark, sf_dir):
    return ranking.top_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id")


@query("""WITH r AS (SELECT lang AS provider, upper(source) AS family, source || ':' || lpad(CAST(n_chars AS VARCHAR), 7, '0') AS code, doc_id FROM documents)
SELECT provider, max(code) AS code, count(*) - 1 AS hidden FROM r GROUP BY provider, family""")
def release_collapse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("provider"), F.concat("source", F.lit(":"), F.lpad(F.col("n_chars").cast("string"), 7, "0")).alias("code"), F.lit("").alias("indexed_at"), F.col("doc_id").alias("seq"))
    return ranking.collapse_releases(docs).select("provider", "code", "hidden")


@query("""WITH v AS (SELECT o_custkey, (o_orderkey % 7) || '.' || (o_orderkey % 13) || '.' || o_orderkey AS version, [o_orderkey % 7, o_orderkey % 13, o_orderkey] AS k FROM orders)
SELECT o_custkey, version FROM v QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC) = 1""")
def newest_version(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws(".", (F.col("o_orderkey") % 7).cast("string"), (F.col("o_orderkey") % 13).cast("string"), F.col("o_orderkey").cast("string")).alias("version"))
    return ranking.newest_version(o, ["o_custkey"], "version", "o_orderkey").select("o_custkey", "version")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))")
def keep_first_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_title(F.col("text"))).alias("key"))
    return ranking.keep_first(docs, ["key"], F.col("doc_id")).select("doc_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS first_seen FROM events GROUP BY user_id")
def last_wins_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return ranking.last_wins(e, "user_id", "event_id")


@query("""SELECT l_partkey, l_suppkey, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT *, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) = 1) WHERE l_discount <= 0.05
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_tax, v, l_orderkey * 10 + l_linenumber) = 1""")
def candidate_choice(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    version = F.when(F.col("l_returnflag") == "N", "publishedVersion").when(F.col("l_returnflag") == "A", "acceptedVersion").otherwise("submittedVersion")
    c = li.withColumn("version", version).withColumn("passed", F.col("l_discount") <= 0.05).withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ranking.choose_candidate(c, "l_partkey", "l_suppkey", "l_tax", "version", "passed", "seq").select("l_partkey", "l_suppkey", "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query("SELECT l_orderkey, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN 2 ELSE 1 END, l_linenumber, l_partkey) = 1")
def best_item_of_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("name", F.concat_ws(" ", F.when(F.col("l_returnflag") == "R", "full report").when(F.col("l_returnflag") == "A", "summary").otherwise("annex"), F.lpad(F.col("l_partkey").cast("string"), 12, "0")))
    return ranking.best_pdf(li, "l_orderkey", "name", "l_linenumber").select("l_orderkey", "l_partkey")


@query("""WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations)
SELECT conv_id, turn FROM n QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY nth, role) <= 3""")
def spread_hits(spark, sf_dir):
    return ranking.spread_hits(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", 3).select("conv_id", "turn")


@query("SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def conversation_sequence(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return ranking.rank(table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)), F.col("turn"), name="place", by=["conv_id"]).select("conv_id", "turn", "role", "next_role", F.col("place").cast("long").alias("place"))


# Joins ------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'n' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') WHEN 1 THEN CAST(c_nationkey AS VARCHAR) WHEN 2 THEN lower('NATION_' || c_nationkey) ELSE 'unknown ' || c_nationkey END AS token, c_nationkey FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN token ELSE 'N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END AS iso3 FROM t""")
def country_resolution(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    known = n.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"), F.lit(None).cast("string").alias("iso2"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("m49"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("seq"))
    key, c = F.col("c_nationkey").cast("string"), table(spark, sf_dir, "customer")
    token = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("n"), F.lpad(key, 2, "0"))).when(F.col("c_custkey") % 4 == 1, key).when(F.col("c_custkey") % 4 == 2, F.lower(F.concat(F.lit("NATION_"), key))).otherwise(F.concat(F.lit("unknown "), key))
    return joins.resolve_countries(c.select("c_custkey", token.alias("token")), "token", known).select("c_custkey", "iso3")


@query("WITH a AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 0), b AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 5000) SELECT CAST(coalesce(a.k, b.k) AS BIGINT) AS nationkey, a.k IS NOT NULL AS listed, b.k IS NOT NULL AS has_data FROM a FULL JOIN b ON a.k = b.k")
def codes_full_outer_availability(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("nationkey")).distinct()
    b = table(spark, sf_dir, "customer").where("c_acctbal < 5000").select(F.col("c_nationkey").cast("long").alias("nationkey"))
    return joins.codes_with_availability(a, b, ["nationkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def economies_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_anti(spark, sf_dir):
    return joins.missing_entities(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'returned' WHEN l_returnflag = 'R' THEN 'r' WHEN l_returnflag = 'A' THEN 'accepted' END AS note, CASE WHEN l_linestatus = 'O' THEN 'open' WHEN l_returnflag = 'R' THEN 'EUR' END AS unit FROM lineitem""")
def group_attribute_override(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", "l_linenumber", F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus").alias("dims"), F.when(F.col("l_linestatus") == "O", F.create_map(F.lit("unit"), F.lit("open"))).alias("attrs"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("series"))
    groups = spark.createDataFrame([({"flag": "R"}, {"note": "r", "unit": "EUR"}, 1), ({"flag": "A"}, {"note": "accepted"}, 2), ({"flag": "R", "status": "F"}, {"note": "returned"}, 3), ({}, {"note": "never"}, 4)], "keys map<string,string>, attrs map<string,string>, seq int")
    series = rows.select("series", "dims", "attrs").dropDuplicates(["series"])
    marked = joins.group_attributes(series, groups, "series").select("series", F.element_at("attrs", F.lit("note")).alias("note"), F.element_at("attrs", F.lit("unit")).alias("unit"))
    return rows.join(marked, "series", "left").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "note", "unit")


@query("""WITH a AS (SELECT o_custkey, strftime(o_orderdate, '%Y') AS period, count(*) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), b AS (SELECT o_custkey, strftime(o_orderdate, '%Y') AS period, count(*) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.period, b.period) AS period, coalesce(a.v, 0) AS a_value, coalesce(b.v, 0) AS b_value, coalesce(b.v - a.v, 0) AS difference FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.period = b.period""")
def compare_releases(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy"))
    a, b = (o.where(F.col("o_orderstatus") == s).groupBy("o_custkey", "period").agg(F.count("*").alias("value")) for s in ("F", "O"))
    return joins.compare_releases(a, b, ["o_custkey", "period"]).fillna(0, ["a_value", "b_value", "difference"])


@query("""WITH top AS (SELECT p_brand, count(*) AS matches FROM part WHERE contains(lower(p_name), 'ring') GROUP BY p_brand ORDER BY matches DESC, p_brand LIMIT 3)
SELECT p_brand AS dataset, matches, p_partkey FROM part JOIN top USING (p_brand) WHERE contains(lower(p_name), 'ring') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 4""")
def two_step_series_search(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "dataset").withColumn("series", F.col("p_partkey"))
    return joins.series_of_datasets(part, masks.all_words(F.col("p_name"), "ring"), 3, 4).select("dataset", "matches", "p_partkey")


# Fusion -----------------------------------------------------------------------------------------------------------


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where(masks.all_words(F.col("p_name"), "ring"))
    orders = {"price": F.col("p_retailprice").desc(), "size": F.col("p_size").asc(), "name": F.length("p_name").asc()}
    out = None
    for i, (name, order) in enumerate(orders.items()):
        r = part.orderBy(order, "p_partkey").limit(100)
        r = ranking.rank(r, order, F.col("p_partkey")).select(F.lit(name).alias("source"), F.lit(i).alias("source_order"), "rank", "p_partkey", "p_name", "p_type")
        out = r if out is None else out.unionByName(r)
    return out


@query("""WITH r AS (SELECT * FROM (SELECT p_partkey, p_name, p_type, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE contains(lower(p_name), 'ring')) WHERE rank <= 100
UNION ALL SELECT * FROM (SELECT p_partkey, p_name, p_type, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part WHERE contains(lower(p_name), 'ring')) WHERE rank <= 100
UNION ALL SELECT * FROM (SELECT p_partkey, p_name, p_type, row_number() OVER (ORDER BY length(p_name), p_partkey) AS rank FROM part WHERE contains(lower(p_name), 'ring')) WHERE rank <= 100)
SELECT p_partkey, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, count(*) AS sources FROM r GROUP BY p_partkey""")
def rrf_fusion(spark, sf_dir):
    return _rankings(spark, sf_dir).groupBy("p_partkey").agg(F.round(F.sum(F.lit(1.0) / (fusion.RRF_K + F.col("rank"))), 9).alias("rrf"), F.count("*").alias("sources"))


@query("""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(strip_accents(p_name || ' ' || p_type)), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part)
SELECT p_partkey, (CAST(len(list_filter(w, lambda x: starts_with(x, 'ring'))) > 0 AS INT) + CAST(len(list_filter(w, lambda x: starts_with(x, 'econ'))) > 0 AS INT) + CAST(len(list_filter(w, lambda x: starts_with(x, 'smal'))) > 0 AS INT)) / 3.0::DOUBLE AS coverage FROM w""")
def coverage_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", fusion.coverage(F.concat_ws(" ", "p_name", "p_type"), ["Rings", "econ", "smal"]).alias("coverage"))


@query()
def entity_resolution(spark, sf_dir):
    """Documents of three kinds of sources as items; equal first lines are the same work."""
    docs = table(spark, sf_dir, "documents")
    order = F.pmod(F.col("doc_id"), F.lit(3))
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    items = docs.select(F.concat(F.lit("s"), order.cast("string")).alias("source"), order.cast("int").alias("source_order"), (F.col("doc_id") / 3).cast("int").alias("rank"), F.lit(None).cast("string").alias("doi"), title.alias("title"), (F.lit(2000) + F.pmod("n_chars", F.lit(3))).cast("int").alias("year"), F.col("doc_id").cast("string").alias("item_id"))
    return fusion.resolve(items).select("item_id", "group_id", "group_seq")


# Nested data ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS md5 FROM documents")
def inverted_index_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", nested.inverted_index(F.col("text")).alias("m")).select("doc_id", F.md5(nested.inverted_to_text(F.col("m"))).alias("md5"))


@query("""WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS k FROM nation), r AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS j, count(*) OVER () AS m FROM region)
SELECT n.i * m + r.j AS cell, n_name AS nation, r_name AS region, CAST(n.i * m + r.j AS DOUBLE) AS value FROM n, r""")
def stride_decode(spark, sf_dir):
    from ..sources.payloads import json_stat

    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = n.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("n"))  # 25 and 5 names
    regions = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda x: x["r_name"]).alias("r"))
    one = names.join(F.broadcast(regions), how="cross")

    def dim(c: str):
        return F.struct(F.struct(F.to_json(c).alias("index")).alias("category"))

    cube = F.struct(F.array(F.lit("nation"), F.lit("region")).alias("id"), F.array(F.size("n"), F.size("r")).alias("size"), F.create_map(F.lit("nation"), dim("n"), F.lit("region"), dim("r")).alias("dimension"), F.to_json(F.transform(F.sequence(F.lit(0), F.size("n") * F.size("r") - 1), lambda x: x.cast("double"))).alias("value"))
    cells = json_stat(one.select(F.to_json(cube).alias("body")))
    return cells.select(F.col("value").cast("long").alias("cell"), F.element_at("dims", F.lit("nation")).alias("nation"), F.element_at("dims", F.lit("region")).alias("region"), "value")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT o_custkey, string_agg(p, ',' ORDER BY s) AS priorities FROM (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey")
def distinct_joined(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(nested.distinct_join(F.col("o_orderkey"), F.col("o_orderpriority")).alias("priorities"))


@query(f"WITH {ORDERS} SELECT 'orders' AS dataset, 'total' AS indicator, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities, min(period) || ':' || max(period) AS period, count(*) AS rows FROM series")
def provenance_log(spark, sf_dir):
    from ..sources.files import data_log

    return data_log(_series(spark, sf_dir), "orders", "total", F.col("entity"), F.col("period"), "orders.csv", "file:orders").drop("file", "url", "retrieved")


# Text -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents")
def norm_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_title(F.col("text")).alias("title"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS url, contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/pdf') OR ends_with(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '.pdf') AS is_pdf FROM pages")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("url"), text.looks_like_pdf(F.col("url")).alias("is_pdf"))


@query("SELECT o_orderkey, '10.1596/1813-9450-' || o_orderkey AS doi, 'Policy Research Working Paper ' || o_orderkey AS series FROM orders")
def norm_doi_series(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", text.norm_doi(F.concat(F.lit("https://DX.doi.org/10.1596/1813-9450-"), F.col("o_orderkey").cast("string"))).alias("doi"))
    return o.withColumn("series", text.series_from_doi(F.col("doi")))


@query("SELECT item_id, rtrim(substr(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') AS slug, CASE WHEN len(string_split(h, ' ')) > 10 THEN array_to_string(string_split(h, ' ')[1:10], ' ') || '...' ELSE h END AS short_title FROM (SELECT item_id, text, regexp_extract(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^(.*?)(?:[:–—]\\s| - |$)', 1) AS h FROM benchmark)")
def slug_and_short_title(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.slug(F.col("text")).alias("slug"), text.short_title(F.col("text")).alias("short_title"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^<>]{1,200}>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def html_clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.col("html")).alias("text"))


@query("""WITH p AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), E' \\t\\r') AS t FROM documents)
SELECT doc_id, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, '\\s+')) END) AS BIGINT) AS words, count(*) FILTER (length(t) < 20) AS empty_pages, count(*) FILTER (length(t) < 20) * 2 > count(*) AS likely_scanned FROM p GROUP BY doc_id""")
def page_stats(spark, sf_dir):
    return tidy.page_statistics(_doc_pages(spark, sf_dir))


def _doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")


@query("SELECT item_id AS quote_id, doc_id, CAST(instr(d.text, b.text) - 1 AS BIGINT) AS start FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def quote_exact_occurrences(spark, sf_dir):
    hits = citations.exact_hits(_whole(spark, sf_dir), _quotes(spark, sf_dir))
    return hits.groupBy("quote_id", "doc_id").agg(F.min("start").cast("long").alias("start"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n FROM documents WHERE contains(text, 'the')")
def quote_nonoverlap_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", citations.occurrences(F.col("text"), F.lit("the")).alias("n")).where("n > 0")


NORM = r"lower(strip_accents(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}]*[\x{{2d}}\x{{ad}}\x{{2010}}-\x{{2015}}\x{{2212}}][^\p{{L}}\p{{N}}]*', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))))"


@query(f"WITH b AS (SELECT item_id, {NORM.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents) SELECT item_id AS quote_id, doc_id FROM b, d WHERE length(q) >= 3 AND contains(t, q)")
def quote_normalised(spark, sf_dir):
    return citations.normalised_hits(_whole(spark, sf_dir), _quotes(spark, sf_dir)).select("quote_id", "doc_id").distinct()


@query(f"""WITH b AS (SELECT item_id, {NORM.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, page, t, lead(t) OVER (PARTITION BY doc_id ORDER BY page) AS nxt FROM (SELECT doc_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS BIGINT) AS page, {NORM.format('unnest(string_split(text, chr(10)))')} AS t FROM documents)),
m AS (SELECT item_id, doc_id, page, q, t, instr(right(t, length(q) + 5) || ' ' || left(nxt, length(q) + 5), q) AS pos, length(right(t, length(q) + 5)) AS k FROM b, d WHERE nxt IS NOT NULL AND contains(t || ' ' || nxt, q) AND NOT contains(t, q) AND NOT contains(nxt, q))
SELECT item_id AS quote_id, doc_id, page FROM m WHERE pos > 0 AND pos <= k AND pos + length(q) - 1 > k""")
def quote_cross_page(spark, sf_dir):
    p = citations.normalised(_doc_pages(spark, sf_dir)).select("doc_id", F.col("page").cast("long").alias("page"), "norm")
    q = _quotes(spark, sf_dir).select("quote_id", text.normalize_quote(F.col("quote")).alias("nq"))
    return citations.across_pages(p, q).select("quote_id", "doc_id", "page")


@query(f"""WITH b AS (SELECT item_id, {NORM.format("regexp_extract(text, '^(\\S+ \\S+ \\S+)', 1)")} AS a, {NORM.format("regexp_extract(text, '(\\S+ \\S+ \\S+)$', 1)")} AS z FROM benchmark), d AS (SELECT doc_id, {NORM.format('text')} AS t FROM documents)
SELECT item_id AS quote_id, doc_id FROM b, d WHERE length(a) >= 3 AND length(z) >= 3 AND contains(t, a) AND instr(substr(t, instr(t, a) + length(a)), z) > 0""")
def quote_ellipsis(spark, sf_dir):
    q = _quotes(spark, sf_dir).select("quote_id", F.concat(F.regexp_extract("quote", r"^(\S+ \S+ \S+)", 1), F.lit(" ... "), F.regexp_extract("quote", r"(\S+ \S+ \S+)$", 1)).alias("quote"))
    return citations.ellipsis_hits(_whole(spark, sf_dir), q).select("quote_id", "doc_id")


@query(f"""WITH q AS (SELECT item_id, string_split({NORM.format('text')}, ' ') AS qw FROM benchmark), b AS (SELECT * FROM q WHERE len(qw) >= 4), d AS (SELECT doc_id, string_split({NORM.format('text')}, ' ') AS pw FROM documents),
qc AS (SELECT item_id, n, w, count(*) AS c FROM (SELECT item_id, len(qw) AS n, unnest(qw) AS w FROM b) GROUP BY ALL), pp AS (SELECT doc_id, len(pw) AS m, unnest(pw) AS w, unnest(range(len(pw))) AS i FROM d), pc AS (SELECT doc_id, m, w, count(*) AS c FROM pp GROUP BY ALL),
near AS (SELECT item_id, n, doc_id, m FROM qc JOIN pc USING (w) GROUP BY ALL HAVING sum(least(qc.c, pc.c)) >= 0.8 * n - 1e-9),
k AS (SELECT item_id, n, doc_id, s, unnest(range(m - s + 1)) AS a FROM (SELECT DISTINCT item_id, n, doc_id, m, least(unnest([n, n + greatest(1, n // 5)]), m) AS s FROM near)),
v AS (SELECT k.item_id, n, k.doc_id, s, a, w, least(count(*), any_value(qc.c)) AS c FROM k JOIN qc USING (item_id, n) JOIN pp USING (doc_id, w) WHERE pp.i >= a AND pp.i < a + s GROUP BY ALL),
r AS (SELECT item_id, doc_id, s, a, sum(c) / n AS share FROM v GROUP BY item_id, n, doc_id, s, a)
SELECT item_id AS quote_id, doc_id, CAST(1 AS BIGINT) AS page, round(share, 3) AS score, CAST(a AS BIGINT) AS first_word, CAST(a + s AS BIGINT) AS last_word FROM r WHERE share >= 0.8 QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY share DESC, s, a) = 1""")
def quote_fuzzy(spark, sf_dir):
    hits = citations.fuzzy_hits(_whole(spark, sf_dir), _quotes(spark, sf_dir), 0.8)
    return hits.withColumns({c: F.col(c).cast("long") for c in ("page", "first_word", "last_word")})


@query(f"""WITH b AS (SELECT item_id, text, {NORM.format('text')} AS q FROM benchmark), d AS (SELECT doc_id, text, {NORM.format('text')} AS t FROM documents),
h AS (SELECT item_id, doc_id FROM b, d WHERE contains(d.text, b.text) OR (length(q) >= 3 AND contains(t, q))), c AS (SELECT item_id, item_id * 7 % (SELECT count(*) FROM documents) AS doc_id, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END AS cited_page FROM benchmark UNION ALL SELECT item_id, doc_id, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 2 END FROM h UNION ALL SELECT item_id, -1, 1 FROM benchmark)
SELECT c.item_id AS quote_id, c.doc_id, CAST(cited_page AS BIGINT) AS cited_page, CASE WHEN k.doc_id IS NULL THEN 'NO TEXT' WHEN h.doc_id IS NULL THEN 'NOT FOUND' WHEN cited_page = 1 THEN 'FOUND' ELSE 'OTHER PAGE' END AS verdict FROM (SELECT DISTINCT * FROM c) c LEFT JOIN h ON c.item_id = h.item_id AND c.doc_id = h.doc_id LEFT JOIN documents k ON k.doc_id = c.doc_id""")
def claim_verdicts(spark, sf_dir):
    """Claims on passages: some of documents that hold them, some of others, some without a text; exact tiers only."""
    pages, quotes = _whole(spark, sf_dir), _quotes(spark, sf_dir)
    exact = citations.exact_hits(pages, quotes).select("quote_id", "doc_id", "page", "start", F.lit("exact").alias("tier"))
    norm = citations.normalised_hits(pages, quotes).select("quote_id", "doc_id", "page", "start", F.lit("normalised").alias("tier"))
    hits = exact.unionByName(norm)
    n = pages.agg(F.count("*").alias("n"))
    page = F.when(F.col("quote_id") % 2 == 0, 1).otherwise(2)
    some = quotes.join(F.broadcast(n), how="cross").select("quote_id", (F.col("quote_id") * 7 % F.col("n")).alias("doc_id"), page.alias("cited_page"))
    claims = some.unionByName(hits.select("quote_id", "doc_id", page.alias("cited_page"))).unionByName(quotes.select("quote_id", F.lit(-1).cast("long").alias("doc_id"), F.lit(1).alias("cited_page"))).distinct()
    return citations.verdicts(claims, hits, pages).withColumn("cited_page", F.col("cited_page").cast("long"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / length(text), 9) AS share FROM documents WHERE length(text) > 0")
def letter_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(tidy.letter_share(F.col("text")), 9).alias("share"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS low, strftime(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') || '-31' AS high, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end FROM orders")
def period_bounds(spark, sf_dir):
    q = F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-Q"), F.quarter("o_orderdate").cast("string"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", q.alias("quarter"), F.date_format("o_orderdate", "yyyy-MM").alias("m"))
    return o.select("o_orderkey", "quarter", periods.period_bound(F.col("quarter")).alias("low"), periods.period_bound(F.col("quarter"), end=True).alias("high"), periods.date_bound(F.col("m"), end=True).cast("string").alias("month_end"))


# Extensions: windows over events ----------------------------------------------------------------------------------


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    out = provenance.window_counts(table(spark, sf_dir, "events"), "ts", "1 hour", by=["event_type"])
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    out = provenance.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])
    return out.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")
