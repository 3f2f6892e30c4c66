"""Streams: windowed counts with late data, sessions, duplicates, and upserts from micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Store

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_each).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total of tumbling windows; rows later than ``late`` are not waited for.  Works on a table too."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n of runs of a user's events with gaps below ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    rows = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def first_deliveries(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, though delivered again within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def upsert_stream(stream: DataFrame, store: Store, table: str, checkpoint: str):
    """Each micro-batch replaces its articles in the store; a batch that comes again changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: store.upsert(table, df)).option("checkpointLocation", checkpoint)
