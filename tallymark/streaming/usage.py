"""Usage as a stream: new log rows are taken once as they land, and periods are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COUNTERS, USAGE


def usage_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Usage rows of Parquet files landing in a folder, each file once."""
    return spark.readStream.schema(USAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(stream: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The stream with a row of each key once; a repeat is known for `late` after the first, so the state is bounded."""
    return stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """UTC days by agent and model; a day is final when the watermark has passed its end."""
    timed = stream if "event_time" in stream.columns else stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    out = timed.groupBy(F.window("event_time", "1 day").alias("w"), "agent", "model").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.count("*").alias("n_entries"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("period"), "agent", "model", *COUNTERS, "n_entries")


def activity(stream: DataFrame, gap: str = "5 hours", late: str = "1 day") -> DataFrame:
    """Stretches of activity of a session: requests at most `gap` apart (without the length limit of billing blocks)."""
    timed = stream if "event_time" in stream.columns else stream.withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", late)
    out = timed.groupBy(F.session_window("event_time", gap).alias("w"), "session_id").agg(F.count("*").alias("n_entries"), F.sum("output_tokens").alias("output_tokens"))
    return out.select("session_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n_entries", "output_tokens")
