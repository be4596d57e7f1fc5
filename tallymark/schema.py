"""The usage table: one row a model request, whatever log it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of the usage table, in order, with their types. Counters are non-negative but for extra_tokens;
#: one_hour is the part of cache_creation_tokens that was written for an hour (null: none).
USAGE = T.StructType([
    T.StructField("agent", T.StringType(), False), T.StructField("source_file", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("ts_ms", T.LongType()), T.StructField("session_id", T.StringType()), T.StructField("project", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("candidates", T.ArrayType(T.StringType())),
    T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType()), T.StructField("cache_creation_tokens", T.LongType()),
    T.StructField("cache_read_tokens", T.LongType()), T.StructField("extra_tokens", T.LongType()), T.StructField("reasoning_tokens", T.LongType()),
    T.StructField("message_id", T.StringType()), T.StructField("request_id", T.StringType()), T.StructField("is_sidechain", T.BooleanType()),
    T.StructField("fast", T.BooleanType()), T.StructField("cost_usd", T.DoubleType()), T.StructField("credits", T.DoubleType()),
    T.StructField("message_count", T.LongType()), T.StructField("version", T.StringType()), T.StructField("reset_ms", T.LongType()),
    T.StructField("one_hour", T.LongType()), T.StructField("exact_candidates", T.ArrayType(T.StringType())), T.StructField("override_candidates", T.ArrayType(T.StringType())),
    T.StructField("first_found", T.BooleanType()), T.StructField("extra_as_output", T.BooleanType()), T.StructField("create_as_input", T.BooleanType()),
    T.StructField("ignores_time", T.BooleanType()), T.StructField("recorded_zero", T.BooleanType()), T.StructField("is_fallback", T.BooleanType()),
])
#: Agents whose extra tokens are billed as output; whose first priced name counts even if it costs nothing; whose record of a zero cost is the price.
EXTRA_AS_OUTPUT = {"amp", "codebuff", "copilot", "droid", "gemini", "goose", "hermes", "kilo", "opencode", "qwen", "zcode", "antigravity"}
FIRST_FOUND = {"antigravity", "gemini", "grok", "kilo", "kimi", "openclaw", "qwen", "zcode"}
RECORDED_ZERO = {"cline", "continue", "cyberine", "opencode"}
COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]


def conform(df: DataFrame, agent: str | None = None) -> DataFrame:
    """df with exactly the usage columns: missing counters are 0, missing flags false, other missing columns null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in USAGE.fields:
        kind = f.dataType.simpleString()
        if f.name == "agent" and agent is not None:
            col: Column = F.lit(agent)
        elif f.name in have:
            col = F.col(f"`{have[f.name]}`").cast(kind)
        elif agent is not None and f.name in ("first_found", "extra_as_output"):
            col = F.lit(agent in (FIRST_FOUND if f.name == "first_found" else EXTRA_AS_OUTPUT))
        elif agent in RECORDED_ZERO and f.name == "recorded_zero" and "cost_usd" in have:
            col = F.col("cost_usd") == 0
        else:
            col = F.lit(None).cast(kind)
        if f.name in COUNTERS:
            col = F.coalesce(col, F.lit(0).cast("long"))
        elif kind == "boolean":
            col = F.coalesce(col, F.lit(False))
        out.append(col.alias(f.name))
    return df.select(*out)


def total_tokens() -> Column:
    """All tokens of a usage row."""
    return F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens") + F.col("extra_tokens")
