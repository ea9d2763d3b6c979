"""Parsers of statistical and bibliographic payloads: nested JSON and XML to tidy rows. Payloads are rows of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALUES = "array<struct<id:string,name:string,value:string>>"
DIMENSIONS = f"array<struct<id:string,keyPosition:int,values:{VALUES}>>"
ATTRIBUTES = f"array<struct<id:string,values:{VALUES}>>"
STRUCTURE = f"struct<dimensions:struct<dataSet:{DIMENSIONS},series:{DIMENSIONS},observation:{DIMENSIONS}>,attributes:struct<dataSet:{ATTRIBUTES},series:{ATTRIBUTES},observation:{ATTRIBUTES}>>"
DATASET = "struct<attributes:array<int>,series:map<string,struct<attributes:array<int>,observations:map<string,array<string>>>>,observations:map<string,array<string>>>"
INNER = f"dataSets:array<{DATASET}>,structure:{STRUCTURE},structures:array<{STRUCTURE}>"
SDMX_JSON = f"struct<{INNER},data:struct<{INNER}>>"


def _coded(dims: Column, key: Column) -> Column:
    """Entries (id, code, label) of a ``i:j:k`` key; a part that is no index of its dimension stands for itself."""
    parts = F.split(key, ":")

    def entry(d: Column, i: Column) -> Column:
        part = F.get(parts, i)
        value = F.get(d["values"], part.try_cast("int"))
        code = F.coalesce(value["id"], part)
        return F.struct(d["id"].alias("id"), code.alias("code"), F.when(value["name"] != code, value["name"]).alias("label"))

    return F.filter(F.transform(dims, entry), lambda e: e["code"].isNotNull())


def _attributes(attrs: Column, indexes: Column) -> Column:
    def entry(a: Column, i: Column) -> Column:
        v = F.get(a["values"], F.get(indexes, i).cast("int"))
        return F.struct(a["id"].alias("key"), F.coalesce(v["id"], v["name"], v["value"]).alias("value"))

    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.filter(F.coalesce(F.transform(attrs, entry), none), lambda e: e["value"].isNotNull() & (e["value"] != ""))


def sdmx_json(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(dims, labels, period, value, attrs) of each observation; versions 1 and 2, series or flat observations.

    Flat observations have no series and carry all dimensions in their own keys.
    """
    x = payloads.select(F.from_json(body, SDMX_JSON).alias("m"))
    x = x.select(F.coalesce("m.data.dataSets", "m.dataSets").alias("sets"), F.coalesce("m.data.structure", F.get("m.data.structures", F.lit(0)), "m.structure", F.get("m.structures", F.lit(0))).alias("s"))
    x = x.select("s", F.explode("sets").alias("d"))
    by_key = F.array_sort(F.transform("s.dimensions.series", lambda v, i: F.struct(F.coalesce(v["keyPosition"], i).alias("p"), v["id"].alias("id"), v["values"].alias("values"))))
    flat = F.map_from_entries(F.array(F.struct(F.lit("").alias("key"), F.struct(F.array().cast("array<int>").alias("attributes"), F.col("d.observations").alias("observations")).alias("value"))))
    series = x.select("s", "d", by_key.alias("sd"), F.explode(F.coalesce(F.when(F.size("d.series") > 0, F.col("d.series")), flat)).alias("sk", "sv"))
    obs = series.select("s", "d", "sd", "sk", "sv", F.explode("sv.observations").alias("ok", "ov"))
    none = F.array().cast("array<struct<id:string,code:string,label:string>>")
    own = F.coalesce(F.when(F.col("sk") != "", _coded(F.col("sd"), F.col("sk"))), none)
    entries = F.concat(own, F.coalesce(_coded(F.col("s.dimensions.observation"), F.col("ok")), none))
    attrs = F.concat(_attributes(F.col("s.attributes.dataSet"), F.col("d.attributes")), _attributes(F.col("s.attributes.series"), F.col("sv.attributes")), _attributes(F.col("s.attributes.observation"), F.slice(F.transform("ov", lambda v: v.try_cast("int")), 2, 1000)))
    rows = obs.select(entries.alias("e"), F.get("ov", F.lit(0)).alias("value"), attrs.alias("a"))
    period = F.get(F.filter("e", lambda v: v["id"] == "TIME_PERIOD"), F.lit(0))["code"]

    def last(entries_: Column) -> Column:
        keys = F.array_distinct(F.transform(entries_, lambda v: v["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(entries_, lambda v: v["key"] == k), -1)["value"])))

    return rows.select(F.map_from_entries(F.transform("e", lambda v: F.struct(v["id"], v["code"]))).alias("dims"), F.map_from_entries(F.transform(F.filter("e", lambda v: v["label"].isNotNull()), lambda v: F.struct(v["id"], v["label"]))).alias("labels"), period.alias("period"), F.coalesce("value", F.lit("")).alias("value"), last(F.col("a")).alias("attrs"))


def json_stat(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(dims, period, value, status) of the cells of JSON-stat cubes, sparse or dense; only wholly empty cells go.

    A cell's place in each dimension follows from row-major strides: ``floor(cell / stride) mod size``.
    """
    t = "struct<id:array<string>,size:array<int>,dimension:map<string,struct<category:struct<index:string,label:map<string,string>>>>,value:string,status:string>"
    x = payloads.select(F.from_json(body, t).alias("m")).select("m.*")
    x = x.withColumn("row", F.monotonically_increasing_id())

    def cells(c: str, kind: str) -> Column:
        dense = F.transform(F.from_json(c, f"array<{kind}>"), lambda v, i: F.struct(i.cast("long").alias("cell"), v.cast("string").alias("v")))
        sparse = F.transform(F.map_entries(F.from_json(c, f"map<string,{kind}>")), lambda e: F.struct(e["key"].cast("long").alias("cell"), e["value"].cast("string").alias("v")))
        none = F.array().cast("array<struct<cell:bigint,v:string>>")
        return F.coalesce(F.when(F.col(c).rlike(r"^\s*\["), dense).when(F.col(c).rlike(r"^\s*\{"), sparse), none)

    strides = F.transform("size", lambda s, i: F.aggregate(F.slice(F.col("size"), i + 2, F.size("size")), F.lit(1).cast("long"), lambda a, b: a * b))

    def codes(index: Column) -> Column:
        as_list = F.from_json(index, "array<string>")
        as_map = F.transform(F.array_sort(F.transform(F.map_entries(F.from_json(index, "map<string,int>")), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("k")))), lambda v: v["k"])
        return F.when(index.rlike(r"^\s*\["), as_list).otherwise(as_map)

    order = F.transform("id", lambda d: F.coalesce(codes(F.element_at("dimension", d)["category"]["index"]), F.map_keys(F.element_at("dimension", d)["category"]["label"])))
    x = x.select("id", "size", strides.alias("strides"), order.alias("codes"), cells("value", "double").alias("vs"), cells("status", "string").alias("ss"))
    both = F.array_distinct(F.concat(F.transform("vs", lambda v: v["cell"]), F.transform("ss", lambda v: v["cell"])))
    x = x.select("id", "size", "strides", "codes", F.map_from_entries("vs").alias("vm"), F.map_from_entries("ss").alias("sm"), F.explode(both).alias("cell"))
    value, status = F.element_at("vm", F.col("cell")), F.element_at("sm", F.col("cell"))
    at = F.transform("id", lambda d, i: F.struct(d, F.get(F.get("codes", i), F.pmod(F.floor(F.col("cell") / F.get("strides", i)), F.get("size", i)).cast("int"))))
    rows = x.select("id", F.map_from_entries(at).alias("dims"), value.try_cast("double").alias("value"), status.alias("status")).where("value is not null or status is not null")
    period = F.coalesce(F.element_at("dims", F.lit("time")), F.element_at("dims", F.element_at("id", -1)))
    return rows.select("dims", period.alias("period"), "value", "status")


def envelope(payloads: DataFrame, row_ddl: str, body: str = "body") -> DataFrame:
    """Rows of ``[meta, rows]`` payloads; a message in place of the rows is an error."""
    message = F.get_json_object(body, "$[0].message[0].value")
    checked = F.when(message.isNotNull(), F.raise_error(F.concat(F.lit("service: "), message)).cast("string")).otherwise(F.get_json_object(body, "$[1]"))
    return payloads.select(F.explode(F.from_json(checked, f"array<{row_ddl}>")).alias("r")).select("r.*")


#: Observations of SDMX-ML as XML columns: attributes carry an underscore.
def sdmx_ml_generic(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(dims, period, value) of generic SDMX-ML; prefixes must be stripped or absent."""
    pair = "array<struct<_id:string,_value:string>>"
    t = f"struct<DataSet:struct<Series:array<struct<SeriesKey:struct<Value:{pair}>,Obs:array<struct<ObsDimension:struct<_value:string>,ObsValue:struct<_value:string>>>>>,Obs:array<struct<ObsKey:struct<Value:{pair}>,ObsValue:struct<_value:string>>>>>"
    x = payloads.select(F.from_xml(without_prefixes(F.col(body)), t).alias("m"))

    def as_map(values: Column) -> Column:
        return F.map_from_entries(F.transform(values, lambda v: F.struct(v["_id"], v["_value"])))

    series = x.select(F.explode("m.DataSet.Series").alias("s")).select(as_map(F.col("s.SeriesKey.Value")).alias("dims"), F.explode("s.Obs").alias("o"))
    series = series.select("dims", F.col("o.ObsDimension._value").alias("period"), F.coalesce("o.ObsValue._value", F.lit("")).alias("value"))
    flat = x.select(F.explode("m.DataSet.Obs").alias("o")).select(as_map(F.col("o.ObsKey.Value")).alias("dims"), F.coalesce("o.ObsValue._value", F.lit("")).alias("value"))
    return series.unionByName(flat.select("dims", F.element_at("dims", F.lit("TIME_PERIOD")).alias("period"), "value"))


def sdmx_ml_specific(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(dims, period, value) of structure-specific SDMX-ML, whose attributes are the dimensions."""
    text = without_prefixes(F.col(body))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)<Series\b(?:[^>]*/>|.*?</Series>)"), F.lit(0))
    blocks = payloads.select(F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(text))).alias("s"))
    head = F.regexp_extract("s", r"^<Series\b([^>]*)>", 1)
    obs = blocks.select(head.alias("h"), F.explode(F.regexp_extract_all(F.col("s"), F.lit(r"<Obs\b([^>]*?)/?>"), F.lit(1))).alias("o"))
    both = obs.select(xml_attributes(F.col("h")).alias("d"), xml_attributes(F.col("o")).alias("a"))
    names = F.array(F.lit("OBS_VALUE"))
    dims = F.map_filter(F.map_concat(F.map_filter("d", lambda k, v: ~F.map_contains_key("a", k)), "a"), lambda k, v: ~F.array_contains(names, k))
    return both.select(dims.alias("dims"), F.element_at("a", F.lit("TIME_PERIOD")).alias("period"), F.coalesce(F.element_at("a", F.lit("OBS_VALUE")), F.lit("")).alias("value"))


def without_prefixes(xml: Column) -> Column:
    """XML text without namespace prefixes on its tags."""
    return F.regexp_replace(xml, r"(</?)[A-Za-z0-9_.-]+:", "$1")


def xml_attributes(tag: Column) -> Column:
    """Attributes of a tag's text as a map."""
    pattern = F.lit(r"""(?:^|\s)([A-Za-z_][\w.:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
    names, double, single = (F.regexp_extract_all(tag, pattern, F.lit(i)) for i in (1, 2, 3))

    def plain(x: Column) -> Column:
        for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(character))
        return x

    return F.map_from_arrays(names, F.zip_with(double, single, lambda a, b: plain(F.concat(a, b))))


def atom_items(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Entries of an Atom feed: id without version, title, authors, date, categories, the DOI given or made."""
    t = "struct<entry:array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,doi:string,category:array<struct<_term:string>>>>>"
    x = payloads.select(F.explode(F.from_xml(without_prefixes(F.col(body)), t)["entry"]).alias("e"))
    bare = F.regexp_replace(F.regexp_extract("e.id", r"([^/]+(?:/\d+)?)$", 1), r"v\d+$", "")
    return x.select(bare.alias("id"), F.trim(F.regexp_replace("e.title", r"\s+", " ")).alias("title"), F.trim(F.regexp_replace("e.summary", r"\s+", " ")).alias("abstract"), F.left("e.published", F.lit(10)).alias("date"), F.transform("e.author", lambda a: a["name"]).alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.coalesce(F.lower("e.doi"), F.concat(F.lit("10.48550/arxiv."), bare)).alias("doi"))


def dimension_tables(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Structure messages as (codelist codes, dimensions by position): agency, id, version, code, name; concept, codelist."""
    text = without_prefixes(F.col(body))
    lists = payloads.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<Codelist\b.*?</Codelist>"), F.lit(0))).alias("c"))
    head = xml_attributes(F.regexp_extract("c", r"^<Codelist\b([^>]*)>", 1))
    codes = lists.select(head.alias("h"), F.explode(F.regexp_extract_all("c", F.lit(r"(?s)<Code\b.*?</Code>"), F.lit(0))).alias("code"))
    code = xml_attributes(F.regexp_extract("code", r"^<Code\b([^>]*)>", 1))
    english = F.coalesce(F.nullif(F.regexp_extract("code", r'<Name[^>]*lang="en"[^>]*>([^<]*)<', 1), F.lit("")), F.regexp_extract("code", r"<Name[^>]*>([^<]*)<", 1))
    codes = codes.select(F.element_at("h", F.lit("agencyID")).alias("agency"), F.element_at("h", F.lit("id")).alias("codelist"), F.element_at("h", F.lit("version")).alias("version"), F.element_at(code, F.lit("id")).alias("code"), english.alias("name"))
    dims = payloads.select(F.posexplode(F.regexp_extract_all(text, F.lit(r"(?s)<(?:Time)?Dimension\b.*?</(?:Time)?Dimension>"), F.lit(0))).alias("i", "d"))
    own = xml_attributes(F.regexp_extract("d", r"^<(?:Time)?Dimension\b([^>]*)>", 1))
    used = xml_attributes(F.regexp_extract("d", r'<Ref\b([^>]*class="Codelist"[^>]*)>', 1))
    dims = dims.select(F.element_at(own, F.lit("id")).alias("dimension"), F.coalesce(F.element_at(own, F.lit("position")).try_cast("int"), F.col("i") + 1).alias("position"), F.element_at(used, F.lit("id")).alias("codelist"), F.element_at(used, F.lit("agencyID")).alias("agency"), F.element_at(used, F.lit("version")).alias("version"))
    return codes, dims.orderBy("position")


def constraint_codes(payloads: DataFrame, body: str = "body") -> DataFrame:
    """(dimension, code) of the key values that a structure message's constraints allow, each once."""
    text = without_prefixes(F.col(body))
    keys = payloads.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<KeyValue\b.*?</KeyValue>"), F.lit(0))).alias("k"))
    own = xml_attributes(F.regexp_extract("k", r"^<KeyValue\b([^>]*)>", 1))
    values = keys.select(F.element_at(own, F.lit("id")).alias("dimension"), F.explode(F.regexp_extract_all("k", F.lit(r"<Value\b[^>]*>([^<]*)</Value>"), F.lit(1))).alias("code"))
    return values.select("dimension", F.trim("code").alias("code")).distinct()


def category_leaves(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """Leaf datasets of an adjacency table (id, parent, name, dataset) with their paths, each dataset once.

    Walks down level by level with an equi-join; a branch that comes back to itself ends at the depth bound.
    """
    level = nodes.where("parent is null").select("id", F.col("name").alias("path"), "dataset")
    out = level.where("dataset is not null")
    for _ in range(depth):
        level = nodes.alias("n").join(level.alias("p"), F.col("n.parent") == F.col("p.id")).select("n.id", F.concat_ws(" / ", "p.path", "n.name").alias("path"), "n.dataset")
        if level.isEmpty():
            break
        out = out.unionByName(level.where("dataset is not null"))
    return out.groupBy("dataset").agg(F.min("path").alias("path"))
