"""Event queries that run on a stream as on a table: daily counts, session windows, running scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import constant_map


def daily_counts(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events by day and type; on a stream, late rows count until the watermark passes the day's end."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def session_windows(events: DataFrame, gap: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Sessions by user that end after a gap; an event exactly at the gap still belongs to its session."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("start"), F.max("ts").alias("last")).select("user_id", "start", "last", "n_events")


def running_scores(events: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Score of each user so far; types without a score add nothing."""
    return events.groupBy("user_id").agg(F.sum(F.coalesce(constant_map(F.col("event_type"), scores), F.lit(0))).cast("long").alias("score"))


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))
