"""Streams: append-only logs, last-record-wins views, duplicates within a watermark, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def append(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append-only: each record is written once, also after a restart."""
    return stream.writeStream.outputMode("append").format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_records(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """The last record of each id so far; for update or complete mode."""
    row = F.struct(*[c for c in stream.columns if c != key])
    return stream.groupBy(key).agg(F.max_by(row, seq).alias("row"), F.min(seq).alias("first_seen"))


def without_repeats(stream: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def window_counts(events: DataFrame, time: str, width: str = "1 hour", slide: str | None = None, by: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling or sliding windows; rows later than the watermark are dropped on a stream."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("w"), *(by or [])).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(by or []), "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")
