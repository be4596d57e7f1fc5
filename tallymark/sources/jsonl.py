"""Agents that log JSON lines: each function reads a folder into the usage table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import lenient_millis, strict_millis
from ..functions.text import basename, is_free, non_empty, part, percent_decoded, stem
from ..functions.tokens import explained, lenient_uint, strict_uint, zero
from ..operators import carry, dedup
from ..schema import conform, total_tokens
from .files import lines, listing, parsed, whole
from .pruning import recent_groups, threshold

#: Keys that may not be set to null anywhere in a line of the first agent's logs.
NULL_FORBIDDEN = ["id", "cwd", "model", "speed", "costUSD", "version", "sessionId", "requestId", "isApiErrorMessage", "cache_read_input_tokens", "cache_creation_input_tokens"]

_CLAUDE_USAGE = (
    "input_tokens: string, output_tokens: string, cache_creation_input_tokens: string, cache_read_input_tokens: string, speed: string, "
    "cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>"
)
_CLAUDE = (
    "timestamp string, sessionId string, version string, requestId string, costUSD double, isSidechain boolean, isApiErrorMessage boolean, "
    f"message struct<id: string, model: string, usage: struct<{_CLAUDE_USAGE}, iterations: array<struct<type: string, model: string, {_CLAUDE_USAGE}>>>>"
)


def _claude_parts(path):
    """(session, project) of a path below `projects`: project/session.jsonl, deeper ones, and subagents' folders."""
    rest = F.split(F.regexp_replace(path, r"^.*?/projects/", ""), "/")
    n = F.size(rest)
    sub = (n >= 4) & (F.element_at(rest, -2) == "subagents")
    up = lambda k: F.when(n > k, F.array_join(F.slice(rest, F.lit(1), n - k), "/"))
    session = F.when(n == 2, F.regexp_replace(F.element_at(rest, -1), r"\.jsonl$", "")).when(sub, F.get(rest, n - 3)).otherwise(F.get(rest, F.greatest(n - 2, F.lit(0))))
    project = F.when(n == 2, F.element_at(rest, 1)).when(sub, up(3)).otherwise(F.when(n > 2, up(2)))
    return session, F.coalesce(project, F.lit("Unknown Project"))


def claude(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """Transcripts `projects/**/*.jsonl`. Lines without valid counters, with a forbidden null or a malformed version are dropped.

    Advisor iterations become rows of their own. Replays are removed: of one (message, request) the main chain,
    then the most tokens, then the fast tier, then the first row stays. Of one message, session and time side chains give way to
    the main chain and one of them stays, whatever their request ids; without request ids, of one message and session.
    Cache writes for an hour are in `one_hour`. `since` (a day): sessions none of whose files was written since are not opened;
    rows of earlier days in the others stay.
    """
    files = recent_groups(listing(spark, root, "*.jsonl"), _claude_parts(F.col("source_file"))[0], threshold(since))
    rows = parsed(lines(spark, root, "*.jsonl", ['"usage":{'], files), _CLAUDE)
    u = F.col("j.message.usage")
    session, project = _claude_parts(F.col("source_file"))
    split = lambda x: F.when(x["cache_creation"].isNotNull(), zero(x["cache_creation"]["ephemeral_5m_input_tokens"]) + zero(x["cache_creation"]["ephemeral_1h_input_tokens"])).otherwise(zero(x["cache_creation_input_tokens"]))
    # Whether a forbidden key is null at any depth. The text of a parsed value spells keys plainly and escapes quotes within
    # strings, so there a key and its null stand behind a brace or comma only where they are meant. An item of
    # `iterations` may leave its model null.
    keys = "|".join(NULL_FORBIDDEN)
    spelled = F.expr("to_json(try_parse_json(value))")
    nulls = F.regexp_count(spelled, F.lit(f'[{{,]"(?:{keys})":null'))
    open_models = F.expr("size(filter(try_variant_get(try_parse_json(value), '$.message.usage.iterations', 'array<variant>'), x -> is_variant_null(try_variant_get(x, '$.model', 'variant'))))")
    may_be = F.col("value").rlike(f'"(?:{keys})"\\s*:\\s*null|\\\\u00[2-7][0-9a-fA-F]')
    null_key = F.when(may_be, nulls > F.greatest(F.coalesce(open_models, F.lit(0)), F.lit(0))).otherwise(F.lit(False))
    valid = (
        F.col("j.timestamp").isNotNull() & strict_uint(u["input_tokens"]).isNotNull() & strict_uint(u["output_tokens"]).isNotNull()
        & (u["cache_creation_input_tokens"].isNull() | strict_uint(u["cache_creation_input_tokens"]).isNotNull())
        & (u["cache_read_input_tokens"].isNull() | strict_uint(u["cache_read_input_tokens"]).isNotNull())
        & F.coalesce(u["speed"].isin("standard", "fast"), F.lit(True)) & ~null_key & F.coalesce(F.col("j.version").rlike(r"^\d+\.\d+\.\d"), F.lit(True))
        & F.coalesce((F.col("j.sessionId") != "") & True, F.lit(True)) & F.coalesce(F.col("j.requestId") != "", F.lit(True))
        & F.coalesce(F.col("j.message.id") != "", F.lit(True)) & F.coalesce(F.col("j.message.model") != "", F.lit(True))
    )
    rows = rows.where(valid).withColumn("ts_ms", lenient_millis(F.col("j.timestamp"))).where("ts_ms is not null")
    fast = F.coalesce(u["speed"] == "fast", F.lit(False))
    model = F.when(F.col("j.message.model") != "<synthetic>", F.concat("j.message.model", F.when(fast, F.lit("-fast")).otherwise(F.lit(""))))
    common = [
        F.col("source_file"), F.col("seq"), F.col("ts_ms"), session.alias("session_id"), project.alias("project"), F.col("j.version").alias("version"),
        F.col("j.requestId").alias("request_id"), F.coalesce("j.isSidechain", F.lit(False)).alias("is_sidechain"), F.col("j.sessionId").alias("data_session"),
    ]
    reset = F.when(F.col("j.isApiErrorMessage"), F.regexp_extract("value", r"usage limit reached\|(\d{9,})", 1).try_cast("long") * 1000)
    main = rows.select(
        *common, model.alias("model"), F.array(F.col("j.message.model")).alias("candidates"), zero(u["input_tokens"]).alias("input_tokens"),
        zero(u["output_tokens"]).alias("output_tokens"), split(u).alias("cache_creation_tokens"), zero(u["cache_creation"]["ephemeral_1h_input_tokens"]).alias("one_hour"),
        zero(u["cache_read_input_tokens"]).alias("cache_read_tokens"), F.col("j.costUSD").alias("cost_usd"), fast.alias("fast"), F.col("j.message.id").alias("message_id"),
        F.lit(0).alias("sub"), reset.alias("reset_ms"),
    )
    steps = rows.select(*common, F.col("j.message.id").alias("mid"), F.posexplode(u["iterations"]).alias("i", "x")).where("x.type = 'advisor_message' and x.model <> ''")
    x = F.col("x")
    advisors = steps.select(
        *[F.col(c) for c in ("source_file", "seq", "ts_ms", "session_id", "project", "version", "request_id", "is_sidechain", "data_session")], x["model"].alias("model"),
        F.array(x["model"]).alias("candidates"), zero(x["input_tokens"]).alias("input_tokens"), zero(x["output_tokens"]).alias("output_tokens"),
        split(x).alias("cache_creation_tokens"), zero(x["cache_creation"]["ephemeral_1h_input_tokens"]).alias("one_hour"), zero(x["cache_read_input_tokens"]).alias("cache_read_tokens"),
        F.lit(None).cast("double").alias("cost_usd"), F.coalesce(x["speed"] == "fast", F.lit(False)).alias("fast"), F.concat("mid", F.lit(":advisor:"), "i").alias("message_id"),
        (F.col("i") + 1).alias("sub"), F.lit(None).cast("long").alias("reset_ms"),
    )
    every = main.unionByName(advisors).withColumn("extra_tokens", F.lit(0).cast("long"))
    # Without a request id a message is told apart by its session and time.
    every = every.withColumn("request_key", F.coalesce("request_id", F.concat_ws("|", F.coalesce("data_session", "session_id"), "ts_ms")))
    place = F.struct("source_file", "seq", "sub")
    best = every.groupBy("message_id", "request_key", F.when(F.col("message_id").isNull(), F.struct("source_file", "seq", "sub")).alias("own")).agg(
        F.min_by(F.struct(*every.columns), F.struct(F.col("is_sidechain"), (-total_tokens()).alias("t"), (~F.col("fast")).alias("f"), place.alias("p"))).alias("r")
    ).select("r.*")
    main_keys = best.where("message_id is not null and not is_sidechain").select("message_id", F.coalesce("data_session", "session_id").alias("__s"), "ts_ms").distinct()
    side = best.where("message_id is not null and is_sidechain").withColumn("__s", F.coalesce("data_session", "session_id"))
    side = side.join(main_keys, ["message_id", "__s", "ts_ms"], "left_anti")
    # Where neither has a request id, a side row replays one of its message and session whatever their times.
    lone_main = best.where("message_id is not null and not is_sidechain and request_id is null").select("message_id", F.coalesce("data_session", "session_id").alias("__s")).distinct()
    lone = side.where("request_id is null").join(lone_main, ["message_id", "__s"], "left_anti")
    side = side.where("request_id is not null").unionByName(lone)
    # Side rows of one time are one request, and so are all times that hold one without a request id.
    better = F.struct((-total_tokens()).alias("t"), (~F.col("fast")).alias("f"), place.alias("p"))
    one = side.groupBy("message_id", "__s", "ts_ms").agg(F.min_by(F.struct(*side.columns), better).alias("r"), F.max(F.col("request_id").isNull()).alias("alone")).select("r.*", "alone")
    side = one.groupBy("message_id", "__s", F.when(~F.col("alone"), F.col("ts_ms")).alias("at")).agg(F.min_by(F.struct(*best.columns), better).alias("r")).select("r.*")
    kept = best.where("message_id is null or not is_sidechain").unionByName(side)
    return conform(kept, "claude")


def qwen(spark: SparkSession, root: str) -> DataFrame:
    """`projects/<project>/chats/*.jsonl`; a total beyond the counters counts as output or extra; equal rows once."""
    rows = parsed(lines(spark, root, "*.jsonl", ['"usageMetadata"']), "type string, sessionId string, timestamp string, model string, usageMetadata struct<promptTokenCount: string, candidatesTokenCount: string, cachedContentTokenCount: string, thoughtsTokenCount: string, totalTokenCount: string>")
    rows = rows.where((F.col("j.type") == "assistant") & F.col("j.usageMetadata").isNotNull() & (part(F.col("source_file"), 2) == "chats"))
    u = F.col("j.usageMetadata")
    inp, out, read, thoughts = (lenient_uint(u[c]) for c in ("promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount", "thoughtsTokenCount"))
    out_all, rest = explained(lenient_uint(u["totalTokenCount"]) - thoughts, inp, out, F.lit(0), read)
    project = part(F.col("source_file"), 3)
    df = rows.select(
        "source_file", "seq", F.coalesce(lenient_millis(F.col("j.timestamp")), "mtime_ms").alias("ts_ms"),
        F.coalesce(F.nullif("j.sessionId", F.lit("")), F.concat(project, F.lit("-"), stem(F.col("source_file")))).alias("session_id"), project.alias("project"),
        F.coalesce(F.nullif("j.model", F.lit("")), F.lit("unknown")).alias("model"), inp.alias("input_tokens"), out_all.alias("output_tokens"), read.alias("cache_read_tokens"), (rest + thoughts).alias("extra_tokens"),
    ).where("input_tokens + output_tokens + cache_read_tokens + extra_tokens > 0")
    df = df.withColumn("candidates", F.array("model", F.concat(F.lit("qwen/"), "model"), F.concat(F.lit("alibaba/"), "model")))
    keys = ["session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_read_tokens", "extra_tokens"]
    return conform(dedup.first_by(df, keys, ["source_file", "seq"]), "qwen")


def kimi(spark: SparkSession, root: str, default_model: str = "kimi-for-coding", renewed_ms: int = 1_776_643_200_000) -> DataFrame:
    """`wire.jsonl` files in two layouts: usage.record lines of whole turns and StatusUpdate messages; equal rows once."""
    ddl = (
        "type string, usageScope string, time string, timestamp string, model string, usage struct<inputOther: string, output: string, inputCacheCreation: string, inputCacheRead: string>, "
        "message struct<type: string, payload: struct<message_id: string, token_usage: struct<input_other: string, output: string, input_cache_creation: string, input_cache_read: string, total: string>>>"
    )
    rows = parsed(lines(spark, root, "wire.jsonl", ['"token_usage"', '"usage.record"']), ddl)
    agent_layout = part(F.col("source_file"), 3) == "agents"
    session = F.coalesce(F.when(agent_layout, part(F.col("source_file"), 4)).otherwise(part(F.col("source_file"), 2)), F.lit("unknown"))
    turn = (F.col("j.type") == "usage.record") & (F.col("j.usageScope") == "turn") & F.col("j.usage").isNotNull()
    status = (F.col("j.message.type") == "StatusUpdate") & F.col("j.message.payload.token_usage").isNotNull() & ~F.coalesce(F.col("j.type").isin("metadata", "usage.record"), F.lit(False))
    a, b = F.col("j.usage"), F.col("j.message.payload.token_usage")
    pick = lambda x, y: F.when(turn, lenient_uint(a[x])).otherwise(lenient_uint(b[y]))
    inp, out, created, read = pick("inputOther", "input_other"), pick("output", "output"), pick("inputCacheCreation", "input_cache_creation"), pick("inputCacheRead", "input_cache_read")
    out_all, extra = explained(F.when(turn, F.lit(0)).otherwise(lenient_uint(b["total"])), inp, out, created, read)
    ts = F.coalesce(F.when(turn, F.col("j.time").try_cast("long")).otherwise((F.col("j.timestamp").try_cast("double") * 1000).cast("long")), F.col("mtime_ms"))
    model = F.when(turn, F.regexp_replace(F.coalesce(non_empty(F.col("j.model")), F.lit(default_model)), "^kimi-code/", "")).otherwise(F.lit(default_model))
    df = rows.where(turn | status).select(
        "source_file", "seq", ts.alias("ts_ms"), session.alias("session_id"), F.lit("Kimi").alias("project"), model.alias("model"), non_empty(F.col("j.message.payload.message_id")).alias("message_id"),
        inp.alias("input_tokens"), out_all.alias("output_tokens"), created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), extra.alias("extra_tokens"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    dated = F.when(F.col("model") == default_model, F.when(F.col("ts_ms") < renewed_ms, F.lit("moonshot/kimi-k2.5")).otherwise(F.lit("moonshot/kimi-k2.6")))
    df = df.withColumn("candidates", F.array_distinct(F.array_compact(F.array(dated, F.concat(F.lit("moonshot/"), "model"), F.concat(F.lit("kimi/"), "model"), "model"))))
    keys = ["session_id", "message_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]
    return conform(dedup.first_by(df, keys, ["source_file", "seq"]), "kimi")


def grok(spark: SparkSession, root: str) -> DataFrame:
    """`updates.jsonl` files: a row for each model of a finished turn; an event and model once; cost in ticks of 1e-10 dollars."""
    one = "inputTokens: string, cachedReadTokens: string, cacheCreationTokens: string, outputTokens: string, reasoningTokens: string, costUsdTicks: string"
    ddl = f"timestamp string, params struct<sessionId: string, _meta: struct<eventId: string, agentTimestampMs: string>, update: struct<sessionUpdate: string, usage: struct<modelUsage: map<string, struct<{one}>>, {one}>>>"
    rows = parsed(lines(spark, root, "updates.jsonl", ['"turn_completed"']), ddl).where("j.params.update.sessionUpdate = 'turn_completed' and j.params.update.usage is not null")
    u = F.col("j.params.update.usage")
    alone = F.array(F.struct(F.lit("unknown").alias("key"), F.struct(*[u[c].alias(c) for c in ("inputTokens", "cachedReadTokens", "cacheCreationTokens", "outputTokens", "reasoningTokens", "costUsdTicks")]).alias("value")))
    per = F.when(F.size(u["modelUsage"]) > 0, F.array_sort(F.map_entries(u["modelUsage"]), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))).otherwise(alone)
    ms, secs = F.col("j.params._meta.agentTimestampMs").try_cast("long"), F.col("j.timestamp").try_cast("long")
    ts = F.when(ms > 0, ms).when(secs > 0, secs * 1000).otherwise(F.lit(0).cast("long"))
    rows = rows.select("source_file", "seq", ts.alias("ts_ms"), F.coalesce(non_empty(F.col("j.params.sessionId")), part(F.col("source_file"), 2)).alias("session_id"),
                       percent_decoded(F.coalesce(part(F.col("source_file"), 3), F.lit("Grok"))).alias("project"), non_empty(F.col("j.params._meta.eventId")).alias("event"), F.posexplode(per).alias("i", "x"))
    x = F.col("x.value")
    inp = lenient_uint(x["inputTokens"])
    read = F.least(lenient_uint(x["cachedReadTokens"]), inp)
    created = F.least(lenient_uint(x["cacheCreationTokens"]), inp - read)
    ticks = lenient_uint(x["costUsdTicks"])
    df = rows.select(
        "source_file", (F.col("seq") * 1000 + F.col("i")).alias("seq"), "ts_ms", "session_id", "project", "event", F.col("x.key").alias("model"), (inp - read - created).alias("input_tokens"),
        lenient_uint(x["outputTokens"]).alias("output_tokens"), created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"),
        lenient_uint(x["reasoningTokens"]).alias("reasoning_tokens"), F.when(ticks > 0, ticks / 1e10).alias("cost_usd"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + reasoning_tokens > 0")
    plain = F.regexp_replace("model", "-build$", "")
    df = df.withColumn("candidates", F.array_distinct(F.array(*[F.concat(F.lit(p), m) for m in (F.col("model"), plain) for p in ("", "xai/", "x-ai/")])))
    df = df.withColumn("exact_candidates", F.col("candidates"))
    own = F.concat_ws("|", "source_file", "session_id", "ts_ms", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "reasoning_tokens")
    df = df.withColumn("__k", F.coalesce("event", own))
    return conform(dedup.first_by(df, ["__k", "model"], ["source_file", "seq"]), "grok")


def commandcode(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts `<project>/<session>.jsonl` and background jobs (`stdout.jsonl` beside `meta.json`).

    A message id counts once a transcript; jobs of a session that has a transcript are left out; a job's events
    count, else its result. Free models and jobs cost nothing.
    """
    use = "inputTokens: string, outputTokens: string, cacheReadTokens: string, cacheWriteTokens: string, costUsd: double"
    scan = lines(spark, root, "*.jsonl", ['"usage"', '"session"', '"model_request_end"', '"type":"result"'])
    is_job = basename(F.col("source_file")) == "stdout.jsonl"
    t = parsed(scan.where(~is_job), f"type string, id string, timestamp string, cwd string, model string, usage struct<{use}>, message struct<meta: struct<createdAt: string>>")
    t = t.withColumn("project", F.coalesce(carry.carried(F.when(F.col("j.type") == "session", F.nullif("j.cwd", F.lit(""))), ["source_file"], ["seq"]), part(F.col("source_file"), 2)))
    t = t.where("j.type = 'message' and j.usage is not null").withColumn("mid", F.col("j.id"))
    t = dedup.first_by(t, ["source_file", "mid"], ["seq"], F.col("mid").isNotNull())
    t = t.select("source_file", "seq", lenient_millis(F.coalesce("j.timestamp", "j.message.meta.createdAt")).alias("ts_ms"), stem(F.col("source_file")).alias("session_id"), "project",
                 F.coalesce(F.nullif("j.model", F.lit("")), F.lit("unknown")).alias("model"), F.col("j.usage").alias("u"), F.col("j.usage.costUsd").alias("given"), F.col("mid").alias("message_id"))
    meta = parsed(whole(spark, root, "meta.json"), "model string, workspace string, startedAt string, finishedAt string, free boolean, sessionId string")
    meta = meta.select(F.regexp_replace("source_file", "/[^/]*$", "").alias("dir"), F.col("j").alias("m"))
    jobs = parsed(scan.where(is_job), f"type string, sessionId string, usage struct<{use}>, event struct<type: string, model: string, usage: struct<{use}>>").withColumn("dir", F.regexp_replace("source_file", "/[^/]*$", ""))
    event = (F.col("j.type") == "event") & (F.col("j.event.type") == "model_request_end") & F.col("j.event.usage").isNotNull()
    w = Window.partitionBy("dir")
    jobs = jobs.withColumns({"event": F.coalesce(event, F.lit(False)), "has": F.max(F.coalesce(event, F.lit(False))).over(w),
                             "last": F.max(F.when(F.col("j.type") == "result", F.col("seq"))).over(w), "sid": F.max_by("j.sessionId", F.when(F.col("j.type") == "result", F.col("seq"))).over(w)})
    jobs = jobs.where(F.col("event") | (~F.col("has") & (F.col("seq") == F.col("last")) & F.col("j.usage").isNotNull())).join(meta, "dir", "left")
    jobs = jobs.select(
        "source_file", "seq", F.coalesce(lenient_millis(F.coalesce("m.startedAt", "m.finishedAt")), "mtime_ms").alias("ts_ms"), F.coalesce("sid", "m.sessionId", F.element_at(F.split("dir", "/"), -1)).alias("session_id"),
        F.coalesce(F.nullif("m.workspace", F.lit("")), F.lit("Command Code")).alias("project"), F.coalesce(F.when(F.col("event"), F.nullif("j.event.model", F.lit(""))), "m.model", F.lit("unknown")).alias("model"),
        F.when(F.col("event"), F.col("j.event.usage")).otherwise(F.col("j.usage")).alias("u"), F.when(F.col("m.free"), F.lit(0.0)).alias("given"), F.lit(None).cast("string").alias("message_id"),
    )
    jobs = jobs.join(t.select("session_id").distinct(), "session_id", "left_anti").select(*t.columns)
    both = t.unionByName(jobs).where("ts_ms is not null")
    raw = lenient_uint(F.col("u.inputTokens"))
    read = F.least(lenient_uint(F.col("u.cacheReadTokens")), raw)
    written = F.least(lenient_uint(F.col("u.cacheWriteTokens")), raw - read)
    out = both.select(
        "source_file", "seq", "ts_ms", "session_id", "project", "model", "message_id", (raw - read - written).alias("input_tokens"), lenient_uint(F.col("u.outputTokens")).alias("output_tokens"),
        written.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), F.coalesce("given", F.when(is_free(F.col("model")), F.lit(0.0))).alias("cost_usd"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens > 0")
    return conform(out, "commandcode")


def continue_dev(spark: SparkSession, root: str, free: tuple[str, ...] = ("ollama", "lmstudio", "llama.cpp", "llamafile")) -> DataFrame:
    """`tokensGenerated.jsonl`: prompt and generated tokens by UTC day; local providers cost nothing; nothing is deduplicated."""
    rows = parsed(lines(spark, root, "tokensGenerated.jsonl"), "timestamp string, model string, provider string, promptTokens string, generatedTokens string")
    df = rows.select("source_file", "seq", lenient_millis(non_empty(F.col("j.timestamp"))).alias("ts_ms"), F.coalesce(non_empty(F.col("j.model")), F.lit("unknown")).alias("model"),
                     F.coalesce(non_empty(F.col("j.provider")), F.lit("")).alias("provider"), lenient_uint(F.col("j.promptTokens")).alias("input_tokens"), lenient_uint(F.col("j.generatedTokens")).alias("output_tokens"))
    return _continue_rows(df, free)


def _continue_rows(df: DataFrame, free: tuple[str, ...]) -> DataFrame:
    day = F.timestamp_millis("ts_ms").cast("timestamp_ntz").cast("date").cast("string")
    plain = F.regexp_replace("model", "-latest$", "")
    df = df.where("ts_ms is not null and input_tokens + output_tokens > 0").select(
        "*", day.alias("session_id"), F.lit("Continue").alias("project"), F.when(F.col("provider").isin(*free), F.lit(0.0)).alias("cost_usd"),
        F.array_distinct(F.array("model", F.concat_ws("/", "provider", "model"), plain, F.concat_ws("/", F.col("provider"), plain))).alias("candidates"),
    )
    return conform(df, "continue")


__all__ = ["claude", "commandcode", "continue_dev", "grok", "kimi", "qwen", "strict_millis"]
