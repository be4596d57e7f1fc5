"""An agent that leaves cumulative snapshots at the end of sessions and telemetry of single requests; each request counts once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import guess_millis, strict_millis
from ..functions.text import non_empty, part
from ..functions.tokens import explained, first_nonzero, without_cached
from ..operators import carry, dedup, joins
from ..schema import conform
from .files import lines, listing

COUNTS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_tokens", "message_count"]
#: Attributes that name the model, and those that name the session, the most telling first with its rank.
MODELS = ["gen_ai.response.model", "gen_ai.request.model"]
SESSIONS = [("session.id", 3), ("copilot_chat.chat_session_id", 3), ("copilot_chat.session_id", 3), ("gen_ai.conversation.id", 3), ("github.copilot.interaction_id", 2), ("gen_ai.response.id", 1)]
#: Pairs of seconds and nanoseconds, the first that is there being the time of a record.
PAIRS = ["endTime", "startTime", "hrTime", "_hrTime", "time"]
#: What the attributes `gen_ai.usage.*` count, in its spellings.
COUNTERS = [
    "input_tokens", "output_tokens", "cache_read.input_tokens", "cache_write.input_tokens", "cache_creation.input_tokens", "reasoning.output_tokens", "reasoning_tokens", "total_tokens", "total.token_count",
]
RESPONSE = "gen_ai.response.id"
#: Kinds of records by precedence: a kind tells of requests only where no earlier one does.
CHAT, INFERENCE, TURN, SUMMARY = range(4)


def _at(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _attr(name: str) -> Column:
    return F.try_variant_get("v", f'$.attributes["{name}"]', "variant")


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _text(x: Column) -> Column:
    """Trimmed text of a JSON string, null for any other value and for blanks."""
    return non_empty(F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def _number(x: Column) -> Column:
    """A whole non-negative number as a double, also from a text of digits; else null."""
    text = F.trim(F.try_variant_get(x, "$", "string"))
    digits = F.when(text.rlike(r"^\+?[0-9]+$"), text.try_cast("double"))
    plain = F.try_variant_get(x, "$", "double")
    whole = F.when((plain >= 0) & (plain == F.floor(plain)), plain)
    return F.when(_kind(x) == "STRING", digits).when(_kind(x).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), whole)


def _count(x: Column) -> Column:
    """A whole non-negative JSON number; anything else is 0."""
    return F.coalesce(F.when(_kind(x) != "STRING", _number(x)), F.lit(0.0)).cast("long")


def _present(x: Column) -> Column:
    return x.isNotNull() & ~F.coalesce(F.is_variant_null(x), F.lit(True))


def _leaves(rows: DataFrame, texts: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """rows with their values as columns of texts and of numbers. Each is read once, behind a generator: filters and
    expressions that use it don't repeat the reading of it, as they would if the optimizer merged them."""
    one = F.struct(F.transform(F.array(*texts.values()), _text).alias("t"), F.transform(F.array(*numbers.values()), _number).alias("n"))
    work = rows.select("*", F.explode(F.array(one)).alias("__x"))
    columns = [F.col(f"__x.{of}")[i].alias(k) for of, names in (("t", texts), ("n", numbers)) for i, k in enumerate(names)]
    return work.select(*rows.columns, *columns)


def _plain_model(x: Column) -> Column:
    """The endings of a model name that only tell of its window."""
    return F.regexp_replace(F.trim(x), "(-1m-internal|-1m)$", "")


def shutdowns(rows: DataFrame) -> DataFrame:
    """Cumulative snapshots (session_id, model, ts_ms, counters) of parsed lines (source_file, seq, v); one shutdown counts once, the latest time winning.

    Events with a metric that isn't an object, without time, and snapshots of nothing are dropped.
    """
    metrics = F.try_variant_get(_at("v", "data.modelMetrics"), "$", "map<string,variant>")
    rows = rows.where(_text(_at("v", "type")) == "session.shutdown").select(
        "source_file", "seq", F.trim(part(F.col("source_file"), 2)).alias("session_id"), strict_millis(_text(_at("v", "timestamp"))).alias("ts_ms"), _text(_at("v", "id")).alias("id"), metrics.alias("metrics"),
    )
    rows = rows.where("ts_ms is not null and session_id <> ''").where(F.forall(F.map_values("metrics"), lambda m: F.startswith(_kind(m), F.lit("OBJECT"))))
    rows = rows.select("source_file", "seq", "session_id", "ts_ms", "id", F.explode("metrics").alias("raw", "m"))
    use = lambda k: _count(_at("m", f"usage.{k}"))
    read, written = use("cacheReadTokens"), use("cacheWriteTokens")
    snaps = rows.where(F.startswith(_kind(_at("m", "usage")), F.lit("OBJECT"))).select(
        "source_file", "seq", "raw", "session_id", "ts_ms", "id", _plain_model(F.col("raw")).alias("model"), use("inputTokens").alias("asked"), without_cached(use("inputTokens"), read + written).alias("input_tokens"),
        use("outputTokens").alias("output_tokens"), written.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), use("reasoningTokens").alias("reasoning_tokens"),
        _count(_at("m", "requests.count")).alias("message_count"),
    ).where("model <> '' and asked + output_tokens + cache_creation_tokens + cache_read_tokens + reasoning_tokens + message_count > 0")
    key = F.coalesce("id", F.concat_ws(":", "ts_ms", "asked", *COUNTS[1:]))
    best = dedup.keep_best(snaps.withColumn("__key", key), ["session_id", "model", "__key"], [F.col("ts_ms"), F.col("source_file"), F.col("seq"), F.col("raw")])
    return best.drop("__key", "id", "asked")


def contexts(records: DataFrame) -> DataFrame:
    """(source_file, trace, c_model, c_session): the first model that a trace names, and its session of the highest rank, of those the first."""
    known = records.where("trace is not null")
    highest = F.min_by("session", F.when(F.col("rank").isNotNull(), F.struct(-F.col("rank"), F.col("seq"))))
    return known.groupBy("source_file", "trace").agg(
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("c_model"), highest.alias("c_session")
    )


def telemetry(rows: DataFrame) -> DataFrame:
    """Requests (session_id, model, ts_ms, counters) that parsed lines (source_file, seq, mtime_ms, v) tell of, each by its most telling record.

    What a record leaves out comes from its trace: the model, else `unknown`; the session, else the trace's id. Records
    without tokens tell nothing; a record of a kind goes where one of an earlier kind has its trace or response id in
    the file.
    """
    rows = rows.where(F.startswith(_kind(_at("v", "attributes")), F.lit("OBJECT")))
    timed = F.lit(False)
    for k in ("startTime", "endTime", "duration", "kind"):
        timed = timed | _present(_at("v", k))
    typed = F.when(_kind(_at("v", "type")) == "STRING", F.try_variant_get("v", "$.type", "string") == "span")
    texts = {k: _at("v", k) for k in ("name", "body", "_body", "traceId", "spanId")} | {"inner": _at("v", "spanContext.traceId"), "event": _attr("event.name"), "op": _attr("gen_ai.operation.name"), "response": _attr(RESPONSE)}
    texts |= {f"m{i}": _attr(a) for i, a in enumerate(MODELS)} | {f"s{i}": _attr(a) for i, (a, _) in enumerate(SESSIONS)}
    numbers = {k: _attr(f"gen_ai.usage.{k}") for k in COUNTERS} | {k: _at("v", k) for k in ("timestamp", "observedTimestamp", "timeUnixNano")}
    numbers |= {f"{k}{i}": _at("v", f"{k}[{i}]") for k in PAIRS for i in (0, 1)}
    rows = _leaves(rows.select("source_file", "seq", "mtime_ms", "v", typed.alias("typed"), timed.alias("timed")), texts, numbers)
    name, event, op, body = F.col("name"), F.col("event"), F.col("op"), F.coalesce("body", "_body")
    says = lambda x, *starts: F.coalesce(x.rlike("^(?:" + "|".join(starts) + ")"), F.lit(False))
    is_ = lambda x, value: F.coalesce(x == value, F.lit(False))
    span = F.coalesce("typed", name.isNotNull() & (F.col("traceId").isNotNull() | F.col("spanId").isNotNull() | F.col("timed")))
    level = (
        F.when(span & (is_(op, "chat") | says(name, "chat ")), CHAT)
        .when(~span & (is_(event, "gen_ai.client.inference.operation.details") | says(body, "GenAI inference:")), INFERENCE)
        .when(~span & (is_(event, "copilot_chat.agent.turn") | says(body, r"copilot_chat\.agent\.turn")), TURN)
        .when(span & (is_(op, "invoke_agent") | says(name, "invoke_agent ")), SUMMARY)
    )
    given = lambda *names: first_nonzero(*[F.col(f"`{n}`") for n in names])
    asked, read, created, out = given("input_tokens"), given("cache_read.input_tokens"), given("cache_write.input_tokens", "cache_creation.input_tokens"), given("output_tokens")
    fresh = without_cached(asked, read)
    out_all, extra = explained(given("total_tokens", "total.token_count"), fresh, out, created, read)
    pair = lambda k: (F.col(f"{k}0") * 1000 + F.floor(F.col(f"{k}1") / 1e6)).cast("long")
    scalar = lambda k: F.coalesce(guess_millis(F.col(k)), F.when(F.col(k) == 0, F.lit(0)))
    nanos = F.when(F.col("timeUnixNano") > 0, F.floor(F.col("timeUnixNano") / 1e6))
    when = F.coalesce(*map(pair, PAIRS), scalar("timestamp"), scalar("observedTimestamp"), nanos, F.col("mtime_ms"))
    records = rows.select(
        "source_file", "seq", F.coalesce("traceId", "inner").alias("trace"), "response", _plain_model(F.coalesce(*[f"m{i}" for i in range(len(MODELS))])).alias("model"),
        F.coalesce(*[f"s{i}" for i in range(len(SESSIONS))]).alias("session"), F.coalesce(*[F.when(F.col(f"s{i}").isNotNull(), F.lit(rank)) for i, (_, rank) in enumerate(SESSIONS)]).alias("rank"),
        level.alias("level"), when.alias("ts_ms"), fresh.alias("input_tokens"), out_all.alias("output_tokens"), created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"),
        extra.alias("extra_tokens"), given("reasoning.output_tokens", "reasoning_tokens").alias("reasoning_tokens"), F.lit(1).cast("long").alias("message_count"),
    )
    told = records.drop("rank").where("level is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    kept = joins.foremost(told, "level", ["trace", "response"], ["source_file"])
    full = kept.join(contexts(records), ["source_file", "trace"], "left")
    return full.withColumns({"model": F.coalesce("model", "c_model", F.lit("unknown")), "session_id": F.coalesce("session", "c_session", "trace", F.lit("unknown-session"))}).drop(
        "c_model", "c_session", "session", "trace", "response", "level"
    )


def copilot(spark: SparkSession, root: str, since_ms: int | None = None, until_ms: int | None = None, exporter: str | None = None) -> DataFrame:
    """Snapshots of session folders (`*/events.jsonl`) as increases between them, and what telemetry (`otel/**/*.jsonl`, or the file
    `exporter`) tells of later than a session's and model's last snapshot.

    Bounds hold for the increases: the last snapshot before `since_ms` is the baseline, and those from `until_ms` on aren't
    there, so that telemetry stands for their time. Lines that aren't JSON objects are dropped; records of telemetry that
    are repeated in several files count each time, as nothing tells them apart from requests of their own.
    """
    parsed = lambda df: df.withColumn("v", F.try_parse_json("value")).where(F.startswith(_kind(F.col("v")), F.lit("OBJECT")))
    listed = listing(spark, root, "*.jsonl")
    otel = F.contains("source_file", F.lit("/otel/"))
    logs = listed.where(otel)
    if exporter:
        logs = dedup.first_by(logs.unionByName(listing(spark, exporter, "*")), ["source_file"], ["mtime_ms"])
    snaps = shutdowns(parsed(lines(spark, root, "*.jsonl", ["session.shutdown"], listed.where(~otel & F.col("source_file").endswith("/events.jsonl")))))
    steps = carry.intervals(snaps, COUNTS, ["session_id", "model"], since_ms=since_ms, until_ms=until_ms)
    any_ = F.lit(0)
    for c in COUNTS:
        any_ = any_ + F.col(c)
    steps = steps.where(any_ > 0).withColumns({"message_count": F.nullif("message_count", F.lit(0).cast("long")), "extra_tokens": F.lit(0).cast("long")}).drop("raw")
    marks = snaps if until_ms is None else snaps.where(F.col("ts_ms") < until_ms)
    told = joins.after_latest(telemetry(parsed(lines(spark, root, "*.jsonl", ['"attributes"'], logs))), marks, ["session_id", "model"], "ts_ms")
    return conform(steps.unionByName(told).withColumn("project", F.lit("GitHub Copilot CLI")), "copilot")
