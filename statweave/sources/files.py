"""File sources and sinks: logs, claims, page texts, country tables, catalogues, CSV, citation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import period_range

SOURCE_LOG = "id string, title string, url string, pdf_url string, notes string, accessed string"
DATA_LOG = "dataset string, indicator string, entities string, period string, rows long, file string, url string, retrieved string"
CLAIMS = "id string, quote string, page int, source_id string, text string"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that don't parse are skipped. ``seq`` is the order in a file, then among files."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("seq"), "value")
    sound = F.col("value").rlike(r"^\s*\{.*\}\s*$") & F.col("r").isNotNull()
    return rows.where(sound).select("r.*", "seq")


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims from a JSON array or from JSON lines, told apart by the first character."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim("value"), 1, 1)).first()
    return spark.read.schema(CLAIMS).json(path, multiLine=bool(first and first[0] == "["))


def page_texts(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Page texts named by an index (doc_id, page, file); a missing file is an empty page."""
    texts = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    return index.join(texts, "file", "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def countries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="iso3 string, iso2 string, m49 string, name string").withColumn("seq", F.monotonically_increasing_id())


def chart_csv(spark: SparkSession, path: str) -> DataFrame:
    """A chart's table: entity, code and year by place, whatever the names; value columns keep theirs."""
    df = spark.read.csv(path, header=True)
    entity, code, year, *values = df.columns
    return df.select(F.col(f"`{entity}`").alias("entity"), F.nullif(F.col(f"`{code}`"), F.lit("")).alias("code"), F.col(f"`{year}`").try_cast("int").alias("year"), *[F.col(f"`{v}`") for v in values])


def table_of_contents(spark: SparkSession, path: str) -> DataFrame:
    """Datasets and tables of a tab-separated catalogue, the first entry of each code."""
    from ..operators.ranking import keep_first

    df = spark.read.csv(path, sep="\t", header=True).withColumn("_seq", F.monotonically_increasing_id())
    return keep_first(df.where(F.col("type").isin("dataset", "table")), ["code"], F.col("_seq")).drop("_seq")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """CSV with a header in a fixed order; null is empty, lists are joined by ``; ``."""
    kinds = dict(df.dtypes)
    out = df.select(*[(F.array_join(c, "; ") if kinds[c].startswith("array") else F.col(c).cast("string")).alias(c) for c in (columns or df.columns)])
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def append_log(df: DataFrame, path: str, schema: str) -> None:
    """Append records in the log's own columns."""
    names = [f.split()[0] for f in schema.split(", ")]
    df.select(*[(F.col(n) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names]).write.mode("append").json(path)


def data_log(df: DataFrame, dataset: str, indicator: str, entity: Column, period: Column, file: str | None, url: str, fallback: str = "") -> DataFrame:
    """The log record of a result, in the same pass as a summary; there is one even when the result is empty."""
    return df.agg(period_range(period, F.lit(fallback)).alias("period"), F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_set(entity)), ",").alias("entities")).select(
        F.lit(dataset).alias("dataset"), F.lit(indicator).alias("indicator"), "entities", "period", "rows", F.when(F.col("rows") > 0, F.lit(file)).alias("file"), F.lit(url).alias("url"), F.current_date().cast("string").alias("retrieved")
    )


def counted(df: DataFrame, name: str = "written") -> tuple[DataFrame, Observation]:
    """The frame with a row counter that is known after it has been written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def citation_line(dataset: Column, indicator: Column, entity: Column, period: Column, retrieved: Column, url: Column) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", dataset, indicator, entity, period, F.concat(F.lit("retrieved "), retrieved), url), F.lit(")"))


def write_pages(pages: DataFrame, path: str) -> None:
    """Page texts, in folders of a bounded number of documents each."""
    pages.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def snapshot(spark: SparkSession, path: str, fetched_at: str, days: int = 30) -> DataFrame | None:
    """A saved table if it is fresh enough, else nothing."""
    from datetime import date

    try:
        age = (date.today() - date.fromisoformat(fetched_at[:10])).days
        return spark.read.parquet(path) if age <= days else None
    except (ValueError, OSError):
        return None
