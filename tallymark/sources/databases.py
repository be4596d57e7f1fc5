"""Agents that keep SQLite databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import strict_millis
from ..functions.text import non_empty
from ..functions.tokens import explained, first_nonzero, lenient_uint
from ..operators import dedup
from ..schema import conform
from .jsonl import _continue_rows, continue_dev
from .sqlite import databases, read_sqlite


def goose(spark: SparkSession, root: str) -> DataFrame:
    """Session totals; accumulated counters count where they are positive; a session once a database."""
    q = "SELECT * FROM sessions WHERE model_config_json IS NOT NULL AND TRIM(model_config_json) != ''"
    kinds = ", ".join(f"{p}{c} long" for p in ("accumulated_", "") for c in ("total_tokens", "input_tokens", "output_tokens"))
    rows = read_sqlite(spark, databases(root, "sessions.db"), [q], f"id string, model_config_json string, provider_name string, created_at string, {kinds}")
    t = F.trim("created_at")
    number = t.try_cast("long")
    ts = F.coalesce(
        F.when(t.rlike(r"^[-+]?\d+$"), F.when(number > 1_000_000_000_000, number).otherwise(number * 1000)), strict_millis(t),
        F.when(F.length(t) == 19, strict_millis(F.concat(F.substring(t, 1, 10), F.lit("T"), F.substring(t, 12, 8), F.lit("Z")))),
        F.when(F.length(t) == 10, strict_millis(F.concat(t, F.lit("T00:00:00Z")))),
    )
    model = non_empty(F.get_json_object("model_config_json", "$.model_name"))
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))
    inp, out = first_nonzero(pos("accumulated_input_tokens"), pos("input_tokens")), first_nonzero(pos("accumulated_output_tokens"), pos("output_tokens"))
    total = F.coalesce(pos("accumulated_total_tokens"), pos("total_tokens"), inp + out)
    given = F.translate(F.nullif(F.trim("provider_name"), F.lit("")), "-", "_")
    guessed = (
        F.when(model.startswith("claude-"), "anthropic").when(model.startswith("gpt-") | model.startswith("chatgpt-") | model.startswith("o"), "openai")
        .when(model.startswith("gemini-"), "google").when(F.lower(model).startswith("qwen"), "openrouter")
    )
    provider = F.coalesce(given, guessed)
    df = rows.select(
        "source_file", "seq", F.col("id").alias("session_id"), F.lit("Goose").alias("project"), ts.alias("ts_ms"), model.alias("model"), inp.alias("input_tokens"), out.alias("output_tokens"),
        F.greatest(total - inp - out, F.lit(0).cast("long")).alias("extra_tokens"), F.array_compact(F.array(model, F.concat(provider, F.lit("/"), model))).alias("candidates"),
    ).where("session_id is not null and ts_ms > 0 and model is not null and input_tokens + output_tokens + extra_tokens > 0")
    return conform(dedup.first_by(df, ["source_file", "session_id"], ["seq"]), "goose")


def hermes(spark: SparkSession, root: str) -> DataFrame:
    """Session rows with recorded cost (actual before estimated); a session once over all databases."""
    ddl = "id string, model string, billing_provider string, started_at double, message_count long, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, estimated_cost_usd double, actual_cost_usd double"
    rows = read_sqlite(spark, databases(root, "state.db"), ["SELECT * FROM sessions"], ddl)
    millis = F.when(F.col("started_at") > 1e12, F.col("started_at")).otherwise(F.col("started_at") * 1000)
    cost = F.greatest(F.coalesce("actual_cost_usd", "estimated_cost_usd"), F.lit(0.0))
    given = F.translate(F.lower(F.nullif(F.trim("billing_provider"), F.lit(""))), "-", "_")
    m = F.lower(F.trim("model"))
    known = F.when(given.isin("anthropic", "claude"), "anthropic").when(given.isin("openai", "openai_codex"), "openai").when(given.isin("google", "google_ai", "gemini", "vertex", "vertex_ai"), "google").otherwise(given)
    guessed = F.when(m.rlike("^claude[-/]"), "anthropic").when(m.rlike(r"^(gpt|chatgpt|o\d)"), "openai").when(m.rlike("^gemini[-/]"), "google")
    provider = F.coalesce(F.when(given.isNotNull(), known), guessed)
    df = rows.select(
        "source_file", "seq", F.col("id").alias("session_id"), F.lit("Hermes").alias("project"), millis.cast("long").alias("ts_ms"), F.trim("model").alias("model"),
        lenient_uint(F.col("input_tokens")).alias("input_tokens"), lenient_uint(F.col("output_tokens")).alias("output_tokens"), lenient_uint(F.col("cache_write_tokens")).alias("cache_creation_tokens"),
        lenient_uint(F.col("cache_read_tokens")).alias("cache_read_tokens"), lenient_uint(F.col("reasoning_tokens")).alias("extra_tokens"), lenient_uint(F.col("message_count")).alias("message_count"),
        F.when(cost > 0, cost).alias("cost_usd"), F.array_compact(F.array(F.concat(provider, F.lit("/"), F.trim("model")), F.trim("model"))).alias("candidates"),
    ).where("session_id <> '' and model <> '' and ts_ms > 0")
    df = df.where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0 or cost_usd > 0")
    return conform(dedup.first_by(df, ["session_id"], ["source_file", "seq"]), "hermes")


def kilo(spark: SparkSession, root: str) -> DataFrame:
    """Assistant messages kept as JSON; a message id once, else a row of its database."""
    rows = read_sqlite(spark, databases(root, "*.db"), ["SELECT id, session_id, data FROM message"], "id string, session_id string, data string")
    ddl = "id string, session_id string, role string, modelID string, providerID string, cost double, time struct<created: bigint>, tokens struct<input: string, output: string, reasoning: string, total: string, cache: struct<read: string, write: string>>"
    rows = rows.where("id is not null and session_id is not null and data is not null").withColumn("j", F.from_json("data", ddl)).where("j.role = 'assistant' and j.tokens is not null")
    t = F.col("j.tokens")
    inp, out, created, read, thought = lenient_uint(t["input"]), lenient_uint(t["output"]), lenient_uint(t["cache"]["write"]), lenient_uint(t["cache"]["read"]), lenient_uint(t["reasoning"])
    out_all, rest = explained(lenient_uint(t["total"]) - thought, inp, out, created, read)
    model, ms = non_empty(F.col("j.modelID")), F.col("j.time.created")
    provider = F.translate(non_empty(F.col("j.providerID")), "-", "_")
    df = rows.select(
        "source_file", "seq", F.coalesce(non_empty(F.col("j.session_id")), "session_id").alias("session_id"), F.lit("Kilo").alias("project"), F.when(ms > 0, F.when(ms < 1_000_000_000_000, ms * 1000).otherwise(ms)).alias("ts_ms"),
        model.alias("model"), inp.alias("input_tokens"), out_all.alias("output_tokens"), created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), (rest + thought).alias("extra_tokens"), F.col("j.cost").alias("cost_usd"),
        F.array_compact(F.array(F.when(~provider.isin("unknown", "kilo"), F.concat(provider, F.lit("/"), model)), model)).alias("candidates"),
        F.coalesce(non_empty(F.col("j.id")), F.concat_ws(":", "source_file", "id")).alias("message_id"),
    ).where("ts_ms is not null and model is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    return conform(dedup.first_by(df, ["message_id"], ["source_file", "seq"]), "kilo")


def zcode(spark: SparkSession, root: str) -> DataFrame:
    """Completed model calls, left-joined with their sessions in the database; an id once; optional columns by schema version."""
    base = "SELECT m.id AS id, m.session_id AS session_id, m.started_at AS started_at, m.model_id AS model_id, m.input_tokens AS input_tokens, m.output_tokens AS output_tokens"
    tail = "s.directory AS directory, {v} AS version FROM model_usage m LEFT JOIN session s ON s.id = m.session_id WHERE m.status = 'completed'"
    full = ", m.cache_creation_input_tokens AS cache_creation, m.cache_read_input_tokens AS cache_read, m.computed_total_tokens AS total, m.provider_id AS provider, "
    bare = ", 0 AS cache_creation, 0 AS cache_read, m.input_tokens + m.output_tokens AS total, NULL AS provider, "
    queries = [base + mid + tail.format(v=v) for mid in (full, bare) for v in ("s.version", "NULL")]
    ddl = "id string, session_id string, started_at double, model_id string, input_tokens double, output_tokens double, cache_creation double, cache_read double, total double, provider string, directory string, version string"
    rows = read_sqlite(spark, databases(root, "*.db"), queries, ddl)
    whole_ = lambda c: F.greatest(F.floor(F.coalesce(F.col(c), F.lit(0.0)) + 0.5), F.lit(0)).cast("long")
    inp = whole_("input_tokens")
    read = F.least(whole_("cache_read"), inp)
    created = F.least(whole_("cache_creation"), inp - read)
    out, extra = explained(whole_("total"), inp - read - created, whole_("output_tokens"), created, read)
    df = rows.where("trim(id) <> '' and trim(session_id) <> '' and trim(model_id) <> '' and started_at > 0").select(
        "source_file", "seq", "session_id", F.coalesce(F.when(F.trim("directory") != "", F.col("directory")), F.lit("ZCode")).alias("project"), F.floor(F.col("started_at") + 0.5).cast("long").alias("ts_ms"),
        F.trim("model_id").alias("model"), (inp - read - created).alias("input_tokens"), out.alias("output_tokens"), created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), extra.alias("extra_tokens"),
        "version", F.col("id").alias("message_id"), F.array_distinct(F.array(F.trim("model_id"), F.lower(F.trim("model_id")))).alias("candidates"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    return conform(dedup.first_by(df, ["message_id"], ["source_file", "seq"]), "zcode")


def continue_db(spark: SparkSession, root: str, free: tuple[str, ...] = ("ollama", "lmstudio", "llama.cpp", "llamafile")) -> DataFrame:
    """`devdata.sqlite`: the same rows as the JSON lines, kept in a table."""
    q = "SELECT model, provider, tokens_generated, tokens_prompt, timestamp FROM tokens_generated ORDER BY id"
    rows = read_sqlite(spark, databases(root, "devdata.sqlite"), [q], "model string, provider string, tokens_generated long, tokens_prompt long, timestamp string")
    ts = F.unix_millis(F.try_to_timestamp(F.concat(F.replace("timestamp", F.lit(" "), F.lit("T")), F.lit("Z"))))
    df = rows.select("source_file", "seq", ts.alias("ts_ms"), F.coalesce("model", F.lit("unknown")).alias("model"), F.coalesce("provider", F.lit("")).alias("provider"),
                     lenient_uint(F.col("tokens_prompt")).alias("input_tokens"), lenient_uint(F.col("tokens_generated")).alias("output_tokens"))
    return _continue_rows(df, free)


def continue_either(spark: SparkSession, root: str) -> DataFrame:
    """The table of `devdata.sqlite` where a folder has one, else the JSON lines: both hold the same requests."""
    return (continue_db if databases(root, "devdata.sqlite") else continue_dev)(spark, root)
