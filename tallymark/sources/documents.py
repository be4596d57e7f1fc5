"""Agents that keep one JSON document a session or thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import lenient_millis, strict_millis
from ..functions.text import non_empty, part, stem
from ..functions.tokens import explained, lenient_uint, without_cached
from ..operators import carry, dedup
from ..schema import conform
from .files import lines, parsed, whole

_TOKENS = (
    "input: string, prompt: string, input_tokens: string, prompt_tokens: string, output: string, candidates: string, output_tokens: string, candidates_tokens: string, cached: string, cached_tokens: string, "
    "thoughts: string, reasoning: string, thoughts_tokens: string, reasoning_tokens: string, tool: string, tool_tokens: string, total: string, total_tokens: string"
)


def _gemini_counts(t):
    """(input without what was cached, output, cache reads, displayed extra) of a token struct.

    The input includes the cached part where input, output, thoughts and tool tokens alone make up the total.
    """
    pick = lambda *names: F.coalesce(*[F.when(t[n].isNotNull(), lenient_uint(t[n])) for n in names], F.lit(0).cast("long"))
    inp, out, cached = pick("input", "prompt", "input_tokens", "prompt_tokens"), pick("output", "candidates", "output_tokens", "candidates_tokens"), pick("cached", "cached_tokens")
    thoughts, tool = pick("thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens"), pick("tool", "tool_tokens")
    given = F.coalesce(F.when(t["total"].isNotNull(), lenient_uint(t["total"])), F.when(t["total_tokens"].isNotNull(), lenient_uint(t["total_tokens"])))
    inclusive = inp + out + thoughts + tool
    overlap = (cached > 0) & (given == inclusive)
    fresh = F.when(overlap, without_cached(inp, cached)).otherwise(inp) + tool
    total = F.coalesce(given, fresh + out + cached + thoughts)
    out_all, _ = explained(total - thoughts, fresh, out, F.lit(0), cached)
    return fresh, out_all, cached, F.greatest(total - (fresh + out_all + cached), F.lit(0).cast("long"))


def gemini(spark: SparkSession, root: str) -> DataFrame:
    """Session JSON with messages, and JSONL whose records replace earlier ones of their id within the file."""
    one = f"type: string, id: string, model: string, timestamp: string, created_at: string, tokens: struct<{_TOKENS}>"
    docs = parsed(whole(spark, root, "*.json"), f"sessionId string, session_id string, startTime string, lastUpdated string, messages array<struct<{one}>>")
    session = F.coalesce(F.nullif("j.sessionId", F.lit("")), F.nullif("j.session_id", F.lit("")), stem(F.col("source_file")))
    late = F.coalesce(lenient_millis(F.col("j.startTime")), lenient_millis(F.col("j.lastUpdated")), F.col("mtime_ms"))
    a = docs.select("source_file", session.alias("session_id"), late.alias("late"), F.posexplode("j.messages").alias("seq", "m"))
    rows = parsed(lines(spark, root, "*.jsonl", ['"gemini"', '"sessionId"']), f"sessionId string, {one.replace(': ', ' ', 0).replace('type: ', 'type ').replace(' id: ', ' id ').replace(' model: ', ' model ').replace(' timestamp: ', ' timestamp ').replace(' created_at: ', ' created_at ').replace(' tokens: ', ' tokens ')}")
    rows = rows.withColumn("session_id", F.coalesce(carry.carried(F.nullif("j.sessionId", F.lit("")), ["source_file"], ["seq"]), stem(F.col("source_file"))))
    m = F.struct(*[F.col(f"j.{c}").alias(c) for c in ("type", "id", "model", "timestamp", "created_at", "tokens")])
    b = rows.select("source_file", "session_id", F.col("mtime_ms").alias("late"), F.col("seq").cast("int").alias("seq"), m.alias("m")).where("m.type = 'gemini'")
    b = dedup.keep_best(b.withColumn("mid", F.col("m.id")), ["source_file", "mid"], [F.col("seq")], F.col("mid").isNotNull()).drop("mid")
    every = a.unionByName(b).where("m.type = 'gemini' and m.tokens is not null and trim(m.model) <> ''")
    fresh, out, cached, extra = _gemini_counts(F.col("m.tokens"))
    df = every.select(
        "source_file", "seq", F.coalesce(lenient_millis(F.col("m.timestamp")), lenient_millis(F.col("m.created_at")), "late").alias("ts_ms"), "session_id", F.lit("Gemini").alias("project"),
        F.col("m.model").alias("model"), fresh.alias("input_tokens"), out.alias("output_tokens"), cached.alias("cache_read_tokens"), extra.alias("extra_tokens"), F.nullif("m.id", F.lit("")).alias("message_id"),
    ).where("input_tokens + output_tokens + cache_read_tokens + extra_tokens > 0")
    return conform(df, "gemini")


def amp(spark: SparkSession, root: str) -> DataFrame:
    """Thread JSON: ledger events joined with their messages' cache counters, or the messages' usage where there is no ledger."""
    ddl = (
        "id string, messages array<struct<role: string, messageId: string, timestamp: string, model: string, usage: struct<timestamp: string, model: string, inputTokens: string, outputTokens: string, "
        "cacheCreationInputTokens: string, cacheReadInputTokens: string, totalTokens: string, credits: double>>>, "
        "usageLedger struct<events: array<struct<timestamp: string, model: string, credits: double, toMessageId: string, tokens: struct<input: string, output: string, total: string>>>>"
    )
    docs = parsed(whole(spark, root, "*.json"), ddl).where(non_empty(F.col("j.id")).isNotNull())
    base = docs.select("source_file", F.trim("j.id").alias("session_id"), F.col("j.messages").alias("ms"), F.col("j.usageLedger.events").alias("ev"))
    ledger = base.where("ev is not null").select("source_file", "session_id", "ms", F.posexplode("ev").alias("seq", "e"))
    # A message's counters are looked up within its own thread; the last of repeated ids counts.
    mine = F.element_at(F.filter("ms", lambda m: (m["role"] == "assistant") & (m["messageId"] == F.col("e.toMessageId"))), -1)
    got = F.when(F.size(F.filter("ms", lambda m: (m["role"] == "assistant") & (m["messageId"] == F.col("e.toMessageId")))) > 0, mine)
    a = ledger.where("e.tokens is not null").select(
        "source_file", "seq", "session_id", strict_millis(non_empty(F.col("e.timestamp"))).alias("ts_ms"), non_empty(F.col("e.model")).alias("model"), lenient_uint(F.col("e.tokens.input")).alias("i"),
        lenient_uint(F.col("e.tokens.output")).alias("o"), lenient_uint(got["usage"]["cacheCreationInputTokens"]).alias("c"), lenient_uint(got["usage"]["cacheReadInputTokens"]).alias("r"),
        lenient_uint(F.col("e.tokens.total")).alias("t"), F.col("e.credits").alias("credits"),
    )
    msgs = base.where("ev is null").select("source_file", "session_id", F.posexplode("ms").alias("seq", "m")).where("m.role = 'assistant' and m.usage is not null")
    b = msgs.select(
        "source_file", "seq", "session_id", strict_millis(F.coalesce(non_empty(F.col("m.usage.timestamp")), non_empty(F.col("m.timestamp")))).alias("ts_ms"),
        F.coalesce(non_empty(F.col("m.usage.model")), non_empty(F.col("m.model"))).alias("model"), lenient_uint(F.col("m.usage.inputTokens")).alias("i"), lenient_uint(F.col("m.usage.outputTokens")).alias("o"),
        lenient_uint(F.col("m.usage.cacheCreationInputTokens")).alias("c"), lenient_uint(F.col("m.usage.cacheReadInputTokens")).alias("r"), lenient_uint(F.col("m.usage.totalTokens")).alias("t"), F.col("m.usage.credits").alias("credits"),
    )
    out, extra = explained(F.col("t"), F.col("i"), F.col("o"), F.col("c"), F.col("r"))
    df = a.unionByName(b).where("ts_ms is not null and model is not null").select(
        "source_file", "seq", "session_id", F.lit("Amp").alias("project"), "ts_ms", "model", F.col("i").alias("input_tokens"), out.alias("output_tokens"), F.col("c").alias("cache_creation_tokens"),
        F.col("r").alias("cache_read_tokens"), extra.alias("extra_tokens"), "credits",
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    return conform(df, "amp")


def cline(spark: SparkSession, root: str, agent: str = "cline") -> DataFrame:
    """Task folders: request messages of `ui_messages.json`, with the model in force by `task_metadata.json`. Nothing is deduplicated."""
    msgs = whole(spark, root, "ui_messages.json").select(
        "source_file", F.posexplode(F.from_json("value", "array<struct<type: string, say: string, ts: double, text: string, modelInfo: struct<modelId: string, providerId: string>>>")).alias("seq", "m")
    ).where("m.type = 'say' and m.say = 'api_req_started' and m.ts is not null")
    msgs = msgs.withColumn("r", F.from_json("m.text", "tokensIn double, tokensOut double, cacheWrites double, cacheReads double, cost double")).where("r.tokensIn is not null and r.tokensOut is not null")
    left = msgs.select("source_file", "seq", part(F.col("source_file"), 2).alias("session_id"), F.col("m.ts").cast("long").alias("ts_ms"), F.col("m.modelInfo").alias("info"), "r")
    meta = parsed(whole(spark, root, "task_metadata.json"), "model_usage array<struct<ts: double, model_id: string, model_provider_id: string>>")
    switches = meta.select(part(F.col("source_file"), 2).alias("session_id"), F.explode("j.model_usage").alias("s")).where(non_empty(F.col("s.model_id")).isNotNull())
    switches = switches.select("session_id", F.coalesce(F.col("s.ts"), F.lit(0)).cast("long").alias("ts_ms"), F.struct(F.col("s.model_id").alias("model"), F.col("s.model_provider_id").alias("provider")).alias("force"))
    got = carry.as_of(left, switches, ["session_id"], "ts_ms", "force")
    model = F.coalesce(non_empty(F.col("info.modelId")), "force.model", F.lit("unknown"))
    provider = F.coalesce(non_empty(F.col("info.providerId")), "force.provider")
    df = got.select(
        "source_file", "seq", "session_id", F.lit("Cline").alias("project"), "ts_ms", model.alias("model"), F.array_distinct(F.array_compact(F.array(model, F.concat(provider, F.lit("/"), model)))).alias("candidates"),
        lenient_uint(F.col("r.tokensIn")).alias("input_tokens"), lenient_uint(F.col("r.tokensOut")).alias("output_tokens"), lenient_uint(F.col("r.cacheWrites")).alias("cache_creation_tokens"),
        lenient_uint(F.col("r.cacheReads")).alias("cache_read_tokens"), F.when(F.col("r.cost") > 0, F.col("r.cost")).alias("cost_usd"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens > 0")
    return conform(df, agent)
