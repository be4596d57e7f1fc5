"""Agents whose sessions carry state over lines, files or stores: carried models, replaced copies, forks and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import lenient_millis, strict_millis
from ..functions.text import basename, non_empty, part
from ..functions.tokens import explained, first_nonzero, lenient_uint, without_cached, zero
from ..operators import carry, dedup, joins
from ..schema import conform
from .files import lines, parsed, whole
from .sqlite import databases, read_sqlite

_CLAW = (
    "type string, customType string, id string, timestamp string, modelId string, model string, provider string, data struct<modelId: string, model: string, provider: string>, "
    "message struct<role: string, timestamp: string, modelId: string, model: string, provider: string, usage: struct<input: string, output: string, cacheRead: string, cacheWrite: string, totalTokens: string, cost: struct<total: double>>>"
)


def _millis(text):
    return F.coalesce(text.try_cast("double").cast("long"), strict_millis(text))


def _claw_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Assistant messages of transcript lines (keys, seq, session_id, late, j) with the model in force."""
    change = (F.col("j.type") == "model_change") | ((F.col("j.type") == "custom") & (F.col("j.customType") == "model-snapshot"))
    inner = F.col("j.data").isNotNull()
    said = lambda *names: F.when(change, F.coalesce(*[non_empty(F.when(inner, F.col(f"j.data.{n}")).otherwise(F.col(f"j.{n}"))) for n in names]))
    work = rows.withColumns({"m": carry.carried(said("modelId", "model"), keys, ["seq"]), "p": carry.carried(said("provider"), keys, ["seq"])})
    work = work.where("j.type = 'message' and j.message.role = 'assistant' and j.message.usage is not null")
    u = F.col("j.message.usage")
    inp, out, created, read, total = (lenient_uint(u[c]) for c in ("input", "output", "cacheWrite", "cacheRead", "totalTokens"))
    out_all, extra = explained(total, inp, out, created, read)
    raw = F.coalesce(non_empty(F.col("j.message.modelId")), non_empty(F.col("j.message.model")), "m", F.lit("unknown"))
    return work.select(
        "source_file", "seq", "session_id", F.lit("OpenClaw").alias("project"), F.coalesce(_millis(F.coalesce("j.message.timestamp", "j.timestamp")), "late").alias("ts_ms"),
        F.concat(F.lit("[openclaw] "), raw).alias("model"), F.array(raw).alias("candidates"), inp.alias("input_tokens"), out_all.alias("output_tokens"), created.alias("cache_creation_tokens"),
        read.alias("cache_read_tokens"), extra.alias("extra_tokens"), u["cost"]["total"].alias("cost_usd"), F.coalesce(non_empty(F.col("j.message.provider")), "p").alias("version"), non_empty(F.col("j.id")).alias("message_id"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")


def openclaw(spark: SparkSession, root: str) -> DataFrame:
    """Transcripts as JSON lines and, since a migration, in SQLite: the database's copy of an entry replaces the file's."""
    scan = parsed(lines(spark, root, "*.jsonl*", ['"model_change"', '"model-snapshot"', '"usage"']), _CLAW)
    name = basename(F.col("source_file"))
    files = _claw_rows(scan.select("source_file", "seq", F.regexp_replace(name, r"(?<=.)\.jsonl.*$", "").alias("session_id"), F.col("mtime_ms").alias("late"), "j"), ["source_file"])
    same = ["session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]
    files = dedup.first_by(files.drop("message_id").withColumn("message_id", F.lit(None).cast("string")), [*same, "cost_usd"], ["source_file", "seq"])
    stores = databases(root, "*.sqlite*")
    if not stores:
        return conform(files, "openclaw")
    rows = read_sqlite(spark, stores, ["SELECT session_id, seq AS n, event_json, created_at FROM transcript_events ORDER BY session_id, seq"], "session_id string, event_json string, created_at long")
    rows = parsed(rows.withColumnRenamed("event_json", "value"), _CLAW).withColumn("late", F.greatest(F.coalesce("created_at", F.lit(0)), F.lit(0)).cast("long"))
    db = _claw_rows(rows, ["source_file", "session_id"])
    db = dedup.first_by(db, ["session_id", "message_id"], ["source_file", "seq"], F.col("message_id").isNotNull()).select(*files.columns)
    # Copies of one entry are paired in order: the k-th of the database replaces the k-th of the files.
    nth = lambda d: d.withColumn("__k", F.row_number().over(Window.partitionBy(*same).orderBy("source_file", "seq")))
    left = nth(files).join(nth(db).select(*same, "__k"), [*same, "__k"], "left_anti").select(*files.columns)
    return conform(left.unionByName(db), "openclaw")


def without_brackets(x: Column) -> Column:
    """A text without what stands in square brackets, nested ones too; an open bracket takes the rest, a closing one alone goes."""
    chars = F.split(x, "")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(at: Column, c: Column) -> Column:
        depth = F.when(c == "[", at["depth"] + 1).when(c == "]", F.greatest(at["depth"] - 1, F.lit(0))).otherwise(at["depth"])
        return F.struct(depth.alias("depth"), F.when((depth == 0) & ~c.isin("[", "]"), F.concat(at["out"], c)).otherwise(at["out"]).alias("out"))

    return F.when(F.contains(x, F.lit("[")) | F.contains(x, F.lit("]")), F.reduce(chars, start, step)["out"]).otherwise(x)


def droid(spark: SparkSession, root: str, suffix: str = ".settings.json") -> DataFrame:
    """A settings snapshot a session, the latest time winning, then the later file; models without brackets and doubled dashes."""
    ddl = "model string, providerLock string, providerLockTimestamp string, tokenUsage struct<inputTokens: string, outputTokens: string, cacheCreationTokens: string, cacheReadTokens: string, thinkingTokens: string, totalTokens: string>"
    rows = parsed(whole(spark, root, f"*{suffix}"), ddl).where("j.tokenUsage is not null")
    session = F.regexp_replace(basename(F.col("source_file")), suffix.replace(".", r"\.") + "$", "")
    side = lines(spark, root, "*.jsonl", ["Model:"]).where("seq < 500").select(
        F.regexp_replace(basename(F.col("source_file")), r"\.jsonl$", "").alias("session_id"), F.regexp_replace("source_file", "/[^/]*$", "").alias("dir"), "seq",
        F.nullif(F.trim(F.regexp_extract("value", r'Model:([^"\\\[]*)', 1)), F.lit("")).alias("side"),
    ).where("side is not null").groupBy("session_id", "dir").agg(F.min_by("side", "seq").alias("side"))
    t = F.col("j.tokenUsage")
    inp, out, created, read, thought = (lenient_uint(t[c]) for c in ("inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens", "thinkingTokens"))
    out_all, rest = explained(lenient_uint(t["totalTokens"]) - thought, inp, out, created, read)
    work = rows.withColumns({"session_id": session, "dir": F.regexp_replace("source_file", "/[^/]*$", "")}).join(side, ["session_id", "dir"], "left")
    plain = lambda m: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(without_brackets(F.regexp_replace(m, "^custom:", ""))), r"[\s.-]+", "-"), "^-+|-+$", ""), F.lit(""))
    lock = F.lower(F.coalesce(non_empty(F.col("j.providerLock")), F.lit("unknown")))
    usual = F.when(lock == "anthropic", "claude-unknown").when(lock == "openai", "gpt-unknown").when(lock == "google", "gemini-unknown").when(lock == "xai", "grok-unknown").otherwise("unknown")
    df = work.select(
        "source_file", F.lit(0).cast("long").alias("seq"), "session_id", F.lit("Droid").alias("project"), F.coalesce(strict_millis(non_empty(F.col("j.providerLockTimestamp"))), "mtime_ms").alias("ts_ms"),
        F.coalesce(plain(non_empty(F.col("j.model"))), plain(F.col("side")), usual).alias("model"), inp.alias("input_tokens"), out_all.alias("output_tokens"), created.alias("cache_creation_tokens"),
        read.alias("cache_read_tokens"), (rest + thought).alias("extra_tokens"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    return conform(dedup.keep_best(df, ["session_id"], [F.col("ts_ms"), F.col("source_file")]), "droid")


def pi(spark: SparkSession, root: str) -> DataFrame:
    """Session trees: only the active branch counts, without what a fork replays from its parent up to the fork's time; equal rows once."""
    ddl = "type string, id string, parentId string, timestamp string, parentSession string, message struct<role: string, model: string, usage: struct<input: string, output: string, cacheRead: string, cacheWrite: string, totalTokens: string, cost: struct<total: double>>>"
    rows = parsed(lines(spark, root, "*.jsonl"), ddl)
    heads = rows.where("seq = 0 and j.type = 'session'").select("source_file", F.col("j.parentSession").alias("parent"), strict_millis(F.col("j.timestamp")).alias("fork_ms"))
    links = rows.where("coalesce(j.type, '') <> 'session' and j.id is not null").select("source_file", "seq", non_empty(F.col("j.id")).alias("id"), non_empty(F.col("j.parentId")).alias("parent_id"))
    on = joins.active_path(links).select("source_file", "seq")
    linked = links.select("source_file").distinct().withColumn("linked", F.lit(True))
    keep = rows.join(linked, "source_file", "left")
    keep = keep.where("linked is null").drop("linked").unionByName(keep.where("linked").drop("linked").join(on, ["source_file", "seq"], "left_semi"))
    u = F.col("j.message.usage")
    inp, out, created, read = (lenient_uint(u[c]) for c in ("input", "output", "cacheWrite", "cacheRead"))
    out_all, extra = explained(lenient_uint(u["totalTokens"]), inp, out, created, read)
    stem_ = F.regexp_replace(basename(F.col("source_file")), r"\.[^.]*$", "")
    raw = non_empty(F.col("j.message.model"))
    df = keep.where("coalesce(j.type, 'message') = 'message' and j.message.role = 'assistant' and j.message.usage is not null").select(
        "source_file", "seq", F.regexp_replace(stem_, "^[^_]*_", "").alias("session_id"), F.coalesce(F.nullif(F.regexp_extract("source_file", "/sessions/([^/]+)/", 1), F.lit("")), F.lit("unknown")).alias("project"),
        strict_millis(non_empty(F.col("j.timestamp"))).alias("ts_ms"), F.concat(F.lit("[pi] "), raw).alias("model"), F.array_compact(F.array(raw)).alias("candidates"), inp.alias("input_tokens"), out_all.alias("output_tokens"),
        created.alias("cache_creation_tokens"), read.alias("cache_read_tokens"), extra.alias("extra_tokens"), F.when(u["cost"]["total"] >= 0, u["cost"]["total"]).alias("cost_usd"),
    ).where("ts_ms is not null and input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0")
    # A fork is compared with its parent row by row; the parent is named by its file, whole or by its last part.
    forks = heads.where("parent is not null").select("source_file", basename(F.col("parent")).alias("pname"), "fork_ms")
    child = df.join(forks, "source_file").withColumn("fork", F.col("source_file"))
    parent = df.withColumn("pname", basename(F.col("source_file"))).join(forks.select(F.col("source_file").alias("fork"), "pname"), "pname").select("fork", *df.columns)
    sign = ["ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens", "cost_usd"]
    rest = joins.without_fork_prefix(child, parent, "fork", "seq", sign, until="fork_ms").select(*df.columns)
    plain = df.join(forks.select("source_file"), "source_file", "left_anti").select(*df.columns)
    return conform(dedup.first_by(plain.unionByName(rest), ["project", "session_id", *sign], ["source_file", "seq"]), "pi")


def cyberine(spark: SparkSession, root: str, cli: tuple[str, ...] = ("claude", "codex", "gemini")) -> DataFrame:
    """Run files (`steps[].workerRuns[]`) and chats (`cacheLedger[]`, else the session's totals); a run counts once."""
    use = "inputTokens: string, outputTokens: string, cacheHitTokens: string, billedUsd: double"
    ddl = (
        f"runId string, cwd string, createdAt string, updatedAt string, steps array<struct<workerRuns: array<struct<provider: string, startedAt: string, updatedAt: string, costModel: string, usage: struct<{use}>>>>>, "
        "id string, model string, provider string, cacheLedger array<struct<at: string, model: string, provider: string, prompt: string, completion: string, hit: string, miss: string, billedUsd: double>>, "
        "sessionTokens struct<prompt: string, completion: string, plannerUsd: double>"
    )
    docs = parsed(whole(spark, root, "*.json"), ddl)
    at = lambda *cols: F.coalesce(*[F.coalesce(F.col(c).try_cast("double").cast("long"), lenient_millis(F.col(c))) for c in cols])
    runs = dedup.first_by(docs.where("j.runId is not null and j.steps is not null").withColumn("run", F.col("j.runId")), ["run"], ["source_file"])
    w = runs.select("source_file", "run", "j", F.posexplode(F.flatten(F.transform("j.steps", lambda s: F.coalesce(s["workerRuns"], F.array())))).alias("seq", "w")).where("w.usage is not null")
    a = w.withColumns({"pv": F.split_part("w.provider", F.lit(":"), F.lit(1)), "mo": F.regexp_replace("w.provider", "^[^:]*:", "")}).where(~F.col("pv").isin(*cli) & F.contains("w.provider", F.lit(":")))
    a = a.select("source_file", "seq", F.col("run").alias("session_id"), F.coalesce(non_empty(F.col("j.cwd")), F.lit("Cyberine")).alias("project"), at("w.startedAt", "w.updatedAt", "j.createdAt", "j.updatedAt").alias("ts_ms"), F.col("mo").alias("model"), "pv",
                 lenient_uint(F.col("w.usage.inputTokens")).alias("p"), lenient_uint(F.col("w.usage.outputTokens")).alias("c"), lenient_uint(F.col("w.usage.cacheHitTokens")).alias("h"), F.lit(None).cast("long").alias("miss"),
                 F.when(F.col("w.costModel").isin("subscription", "free"), F.lit(0.0)).otherwise(F.col("w.usage.billedUsd")).alias("cost_usd"))
    chats = docs.where("j.runId is null").withColumns({"sid": F.coalesce(non_empty(F.col("j.id")), F.regexp_replace(basename(F.col("source_file")), r"\.json$", "")), "dir": F.coalesce(non_empty(F.col("j.cwd")), F.lit("Cyberine chat"))})
    call = chats.where("size(j.cacheLedger) > 0").select("source_file", "sid", "dir", "j", F.posexplode("j.cacheLedger").alias("seq", "x"))
    b = call.select("source_file", "seq", F.col("sid").alias("session_id"), F.col("dir").alias("project"), at("x.at").alias("ts_ms"), F.coalesce(non_empty(F.col("x.model")), non_empty(F.col("j.model"))).alias("model"),
                    F.coalesce(non_empty(F.col("x.provider")), non_empty(F.col("j.provider")), F.lit("deepseek")).alias("pv"), lenient_uint(F.col("x.prompt")).alias("p"), lenient_uint(F.col("x.completion")).alias("c"),
                    lenient_uint(F.col("x.hit")).alias("h"), F.when(F.col("x.miss").isNotNull(), lenient_uint(F.col("x.miss"))).alias("miss"), F.col("x.billedUsd").alias("cost_usd"))
    s = chats.where("coalesce(size(j.cacheLedger), 0) <= 0 and j.sessionTokens is not null").select(
        "source_file", F.lit(0).alias("seq"), F.col("sid").alias("session_id"), F.col("dir").alias("project"), at("j.updatedAt", "j.createdAt").alias("ts_ms"), non_empty(F.col("j.model")).alias("model"),
        F.coalesce(non_empty(F.col("j.provider")), F.lit("deepseek")).alias("pv"), lenient_uint(F.col("j.sessionTokens.prompt")).alias("p"), lenient_uint(F.col("j.sessionTokens.completion")).alias("c"),
        F.lit(0).cast("long").alias("h"), F.lit(None).cast("long").alias("miss"), F.col("j.sessionTokens.plannerUsd").alias("cost_usd"))
    every = a.unionByName(b).unionByName(s).where("ts_ms is not null and model is not null")
    read = F.least("h", F.when(F.col("p") > 0, F.col("p")).otherwise(F.col("h")))
    out = every.select("source_file", "seq", "session_id", "project", "ts_ms", "model", F.coalesce("miss", without_cached(F.col("p"), read)).alias("input_tokens"), F.col("c").alias("output_tokens"), read.alias("cache_read_tokens"), "cost_usd",
                       F.array("model", F.concat_ws("/", "pv", "model")).alias("candidates"))
    return conform(out.where("input_tokens + output_tokens + cache_read_tokens > 0 or cost_usd > 0"), "cyberine")


_NAMES = {
    "input": ["inputTokens", "input_tokens", "promptTokens", "prompt_tokens"], "output": ["outputTokens", "output_tokens", "completionTokens", "completion_tokens"],
    "created": ["cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens", "cachedTokensCreated", "cached_tokens_created"],
    "read": ["cacheReadInputTokens", "cache_read_input_tokens"], "total": ["totalTokens", "total_tokens", "total"],
}


def _usage_of(u):
    """Counters, credits and model of a usage struct that may spell its fields in several ways; zeros where it is null."""
    pick = lambda k: first_nonzero(*[F.when(u[n] > 0, u[n]) for n in _NAMES[k]])
    read = F.greatest(pick("read"), zero(u["promptTokensDetails"]["cachedTokens"]), zero(u["prompt_tokens_details"]["cached_tokens"]))
    out, extra = explained(pick("total"), pick("input"), pick("output"), pick("created"), read)
    return {"input": pick("input"), "output": out, "created": pick("created"), "read": read, "extra": extra, "credits": F.greatest(F.coalesce(u["credits"], F.lit(0.0)), F.lit(0.0)), "model": non_empty(u["model"])}


def codebuff(spark: SparkSession, root: str, default_model: str = "codebuff-unknown") -> DataFrame:
    """`chat-messages.json` arrays: of each field the first layer with a value counts (metadata, nested usage, then the run state's latest messages); the last row of an id stays."""
    use = ", ".join(f"{n}: bigint" for ns in _NAMES.values() for n in ns) + ", promptTokensDetails: struct<cachedTokens: bigint>, prompt_tokens_details: struct<cached_tokens: bigint>, credits: double, model: string"
    hist = f"role: string, providerOptions: struct<usage: struct<{use}>, codebuff: struct<model: string, usage: struct<{use}>>>"
    one = f"variant: string, role: string, id: string, timestamp: string, createdAt: string, credits: double, metadata: struct<model: string, timestamp: string, usage: struct<{use}>, codebuff: struct<usage: struct<{use}>>, runState: struct<sessionState: struct<mainAgentState: struct<messageHistory: array<struct<{hist}>>>>>>"
    docs = whole(spark, root, "chat-messages.json").select("source_file", "mtime_ms", F.posexplode(F.from_json("value", f"array<struct<{one}>>")).alias("seq", "m"))
    docs = docs.where(F.coalesce(non_empty(F.col("m.variant")), non_empty(F.col("m.role"))).isin("ai", "agent", "assistant"))
    md = F.col("m.metadata")
    history = F.filter(F.reverse(F.coalesce(md["runState"]["sessionState"]["mainAgentState"]["messageHistory"], F.array())), lambda h: (h["role"] == "assistant") & h["providerOptions"].isNotNull())
    layers = F.concat(F.array(md["usage"], md["codebuff"]["usage"]), F.flatten(F.transform(history, lambda h: F.array(h["providerOptions"]["usage"], h["providerOptions"]["codebuff"]["usage"]))))
    work = docs.withColumn("layers", F.filter(layers, lambda x: x.isNotNull())).withColumn("own", F.transform(history, lambda h: non_empty(h["providerOptions"]["codebuff"]["model"])))
    fields = ("input", "output", "created", "read", "extra", "credits")
    work = work.withColumn("parsed", F.transform("layers", lambda x: F.struct(*[c.alias(n) for n, c in _usage_of(x).items()])))
    best = lambda n: F.coalesce(F.get(F.filter(F.transform("parsed", lambda x: x[n]), lambda v: v > 0), 0), F.lit(0))
    work = work.withColumns({f"u_{n}": best(n) for n in fields})
    model = F.coalesce(non_empty(md["model"]), F.get(F.filter(F.concat(F.transform("parsed", lambda x: x["model"]), "own"), lambda v: v.isNotNull()), 0), F.lit(default_model))
    credits = F.when(F.col("u_credits") > 0, F.col("u_credits")).otherwise(F.greatest(F.coalesce("m.credits", F.lit(0.0)), F.lit(0.0)))
    chat = part(F.col("source_file"), 2)
    chat_time = strict_millis(F.concat(F.split_part(chat, F.lit("T"), F.lit(1)), F.lit("T"), F.regexp_replace(F.split_part(chat, F.lit("T"), F.lit(2)), r"^(\d\d)-(\d\d)-", "$1:$2:")))
    number = lambda c: F.when(F.col(c).try_cast("long") > 0, F.when(F.col(c).try_cast("long") < 10_000_000_000, F.col(c).try_cast("long") * 1000).otherwise(F.col(c).try_cast("long")))
    ts = F.coalesce(*[x for c in ("m.timestamp", "m.createdAt", "m.metadata.timestamp") for x in (strict_millis(F.col(c)), number(c))], F.when(F.contains(chat, F.lit("T")), chat_time), F.col("mtime_ms"))
    session = F.concat_ws("/", F.coalesce(part(F.col("source_file"), 6), F.lit("manicode")), F.coalesce(part(F.col("source_file"), 4), F.lit("unknown")), chat)
    df = work.select(
        "source_file", "seq", session.alias("session_id"), F.lit("Codebuff").alias("project"), ts.alias("ts_ms"), model.alias("model"), F.col("u_input").cast("long").alias("input_tokens"), F.col("u_output").cast("long").alias("output_tokens"),
        F.col("u_created").cast("long").alias("cache_creation_tokens"), F.col("u_read").cast("long").alias("cache_read_tokens"), F.col("u_extra").cast("long").alias("extra_tokens"), F.nullif(credits, F.lit(0.0)).alias("credits"),
        non_empty(F.col("m.id")).alias("message_id"),
    ).where("input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + extra_tokens > 0 or credits > 0")
    key = F.coalesce("message_id", F.concat_ws(":", "ts_ms", "model", "seq", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "extra_tokens"))
    return conform(dedup.keep_best(df.withColumn("__key", key), ["session_id", "__key"], [F.col("source_file"), F.col("seq")]), "codebuff")
