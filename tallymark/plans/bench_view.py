"""The usage table seen in the driver's `events`: a fixed projection, written alike for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Model of a request by its k modulo 12; the last has no price.
MODELS = [
    "claude-opus-4-5", "claude-sonnet-4", "claude-haiku-4-5", "gpt-5", "gpt-5.5", "gpt-5.4-mini", "grok-4.3", "moonshot/kimi-k2.6", "glm-4.6",
    "deepseek-v4-flash", "deepseek-v4-pro", "unlisted-model",
]


def usage_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage rows: one request an event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(
        F.col("event_type").alias("agent"), F.col("event_id").alias("seq"), ms.cast("long").alias("ts_ms"), F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("p"), F.col("user_id") % 10).alias("project"), F.get(F.array(*map(F.lit, MODELS)), (k % 12).cast("int")).alias("model"),
        (k * 100 + 50).alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"), (F.col("event_id") % 7 * 40).alias("cache_creation_tokens"),
        (F.col("event_id") % 11 * 250).alias("cache_read_tokens"), (F.col("event_id") % 5).alias("extra_tokens"), F.floor(F.col("event_id") / 3).cast("string").alias("message_id"),
        (F.col("event_id") % 2).cast("string").alias("request_id"), (F.col("event_id") % 4 == 0).alias("is_sidechain"), (F.col("event_id") % 13 == 0).alias("fast"),
        F.concat(F.lit("v"), F.col("event_id") % 3).alias("version"), F.col("user_id"), k.alias("k"),
        F.lit(None).cast("double").alias("cost_usd"), F.lit(None).cast("long").alias("reset_ms"),
    )


_CASE = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODELS)) + " END"
#: The same rows as a DuckDB common table expression `u`.
USAGE_SQL = f"""e AS (SELECT *, regexp_extract(props, '"k": *(\\d+)', 1)::BIGINT AS k FROM events),
u AS (
  SELECT event_type AS agent, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 's' || user_id AS session_id, 'p' || (user_id % 10) AS project, {_CASE} AS model,
    k * 100 + 50 AS input_tokens, floor(value * 10)::BIGINT AS output_tokens, event_id % 7 * 40 AS cache_creation_tokens, event_id % 11 * 250 AS cache_read_tokens,
    event_id % 5 AS extra_tokens, (event_id // 3)::VARCHAR AS message_id, (event_id % 2)::VARCHAR AS request_id, event_id % 4 = 0 AS is_sidechain,
    event_id % 13 = 0 AS fast, 'v' || (event_id % 3) AS version, user_id, k, epoch_us(ts) // 86400000000 AS day_no, ts FROM e)"""
