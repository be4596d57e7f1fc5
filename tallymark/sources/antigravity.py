"""Antigravity's databases: usage in protocol-buffer blobs, requests that several records tell of merged over all databases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, percent_decoded
from ..operators import dedup
from ..operators.carry import carried
from ..schema import conform
from ..scratch import written
from ..shipping import python_ready
from .sqlite import databases, read_sqlite
from .wire import Message, WireError, millis

#: The model of requests that don't name one, providers by number whose models are Google's, and their names in price lists.
DEFAULT, GOOGLE, PREFIXES = "gemini-internal-model", (3, 24, 30), ("google", "gemini", "vertex_ai", "openrouter/google")
#: Models by number.
BY_ID = {
    246: "gemini-2.5-pro", 281: "claude-4-sonnet", 282: "claude-4-sonnet", 290: "claude-4-opus", 291: "claude-4-opus", 312: "gemini-2.5-flash", 313: "gemini-2.5-flash-thinking",
    329: "gemini-2.5-flash-thinking", 330: "gemini-2.5-flash-lite", 333: "claude-4.5-sonnet", 334: "claude-4.5-sonnet", 340: "claude-4.5-haiku", 341: "claude-4.5-haiku",
    342: "model_openai_gpt_oss_120b_medium", 1071: "gemini-3.6-flash-high", 1072: "gemini-3.6-flash-medium", 1073: "gemini-3.6-flash-low", 1298: "gemini-3.7-flash-high",
    1299: "gemini-3.7-flash-medium", 1300: "gemini-3.7-flash-low", 1318: "gemini-3.8-flash-high", 1319: "gemini-3.8-flash-medium", 1320: "gemini-3.8-flash-low",
}
#: Models by the names that the product shows or sends.
NAMED = {
    "claude 3 opus": "claude-3-opus", "claude 3.5 haiku": "claude-3-5-haiku", "claude 3.5 sonnet": "claude-3-5-sonnet", "claude 3.7 sonnet": "claude-3-7-sonnet", "claude 3.7 sonnet thinking": "claude-3-7-sonnet",
    "gemini 1.5 flash": "gemini-1.5-flash", "gemini 1.5 pro": "gemini-1.5-pro", "gemini 2 flash": "gemini-2.0-flash", "gemini 2.0 flash": "gemini-2.0-flash", "gemini 2.0 pro": "gemini-2.0-pro",
    "gemini 2.5 flash": "gemini-2.5-flash", "gemini 2.5 pro": "gemini-2.5-pro", "gemini 3 flash": "gemini-3.6-flash", "gemini 3 pro": "gemini-3-pro", "gemini 3 pro thinking": "gemini-3-pro",
    "gemini 3.6 flash": "gemini-3.6-flash", "gemini 3.6 pro": "gemini-3.6-pro", "gemini 3.7 flash": "gemini-3.7-flash", "gemini 3.7 flash thinking": "gemini-3.7-flash", "gemini 3.7 pro": "gemini-3.7-pro",
    "gemini 3.7 pro thinking": "gemini-3.7-pro", "gemini 3.8 flash": "gemini-3.8-flash", "gemini 3.8 flash thinking": "gemini-3.8-flash",
    "gemini-3-flash": "gemini-3-flash-preview", "gemini-3-flash-a": "gemini-3.5-flash-high", "gemini-3-flash-agent": "gemini-3.5-flash-high", "gemini-3-flash-agent-a": "gemini-3.5-flash-high",
    "gemini-3-flash-agent-b": "gemini-3.5-flash-high", "gemini-3-flash-b": "gemini-3.5-flash-high", "gemini-3-flash-c": "gemini-3-flash-preview", "gemini-3-pro-high": "gemini-3-pro", "gemini-3-pro-low": "gemini-3-pro",
    "gemini-3.1-pro-high": "gemini-3.1-pro", "gemini-3.1-pro-low": "gemini-3.1-pro", "gemini-3.5-flash-low": "gemini-3.5-flash-medium", "gemini-pro-agent": "gemini-3.1-pro", "gemini-pro-default": "gemini-3.1-pro",
    "model_openai_gpt_oss_120b_medium": "gpt-oss-120b-medium", "model_placeholder_m16": "gemini-3.1-pro", "model_placeholder_m18": "gemini-3-flash-preview", "model_placeholder_m20": "gemini-3.5-flash-medium",
    "model_placeholder_m26": "claude-opus-4-6", "model_placeholder_m35": "claude-sonnet-4-6", "model_placeholder_m36": "gemini-3.1-pro", "model_placeholder_m37": "gemini-3.1-pro", "model_placeholder_m47": "gemini-3-flash-preview",
    "model_placeholder_m71": "gemini-3.6-flash-high", "model_placeholder_m72": "gemini-3.6-flash-medium", "model_placeholder_m73": "gemini-3.6-flash-low", "model_placeholder_m84": "gemini-3-flash-preview",
    "model_placeholder_m132": "gemini-3.5-flash-high", "model_placeholder_m133": "gemini-3.5-flash-high", "model_placeholder_m187": "gemini-3.5-flash-extra-low", "model_placeholder_m298": "gemini-3.7-flash-high",
    "model_placeholder_m299": "gemini-3.7-flash-medium", "model_placeholder_m300": "gemini-3.7-flash-low", "model_placeholder_m318": "gemini-3.8-flash-high", "model_placeholder_m319": "gemini-3.8-flash-medium",
    "model_placeholder_m320": "gemini-3.8-flash-low",
}
#: Kinds of records, in the order in which their requests count.
STEP, GENERATION, TRAJECTORY = 0, 1, 2
_USAGE = "model_id: long, input: long, total: long, created: long, read: long, reasoning: long, visible: long, provider: long, message: string, response: string, remote: string"
_RECORD = f"source_file string, kind int, seq long, ok boolean, model string, model_id long, provider long, at long, usages array<struct<{_USAGE}>>"
_NAMES = [x.split(":")[0] for x in _USAGE.split(", ")]


def _usage(m: Message) -> dict:
    counts = dict(zip(_NAMES[:8], map(m.count, (1, 2, 3, 4, 5, 9, 10, 6)), strict=True))
    texts = dict(zip(_NAMES[8:], map(m.text, (7, 11, 12)), strict=True))
    return counts | {k: counts[k] or None for k in ("model_id", "provider")} | texts


def _usages(m: Message, own: int, retries: int) -> list[dict]:
    """The usage of a record, then those of its retries."""
    found = [m.inner(own), *(r.inner(2) for r in m.every(retries))]
    return [_usage(u) for u in found if u]


def _generation(data: bytes) -> dict:
    m = Message(data).inner(1)
    if m is None:
        raise WireError("no model message")
    info = m.inner(9)
    return {"model": m.text(19) or m.text(21), "model_id": m.count(3) or None, "provider": None, "at": millis(info.inner(4)) if info else None, "usages": _usages(m, 4, 17)}


def _step(data: bytes) -> dict:
    m = Message(data)
    info = m.inner(24)
    usages = _usages(m, 9, 28)
    named = {"model": info.text(12) or info.text(8), "model_id": info.count(1) or None, "provider": info.count(7) or None} if info else dict.fromkeys(("model", "model_id", "provider"))
    return named | {"at": millis(m.inner(8) or m.inner(1)), "usages": usages}


def _trajectory(data: bytes) -> dict:
    return {"model": None, "model_id": None, "provider": None, "at": millis(Message(data).inner(2)), "usages": []}


_READERS: dict[int, Callable[[bytes], dict]] = {STEP: _step, GENERATION: _generation, TRAJECTORY: _trajectory}


def decoded(rows: DataFrame) -> DataFrame:
    """Records (source_file, kind, seq, blob) read in Arrow batches; ok is false where a blob can't be read."""
    fields = [pa.field(n, pa.string() if n in _NAMES[8:] else pa.int64()) for n in _NAMES]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct(fields))]
    names = ["source_file", "kind", "seq", "ok", "model", "model_id", "provider", "at", "usages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, kind, seq, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append((file, kind, seq, True, *(_READERS[kind](blob)[n] for n in names[4:])))
                except (WireError, TypeError):  # a null blob is none
                    out.append((file, kind, seq, False, None, None, None, None, []))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

    return rows.select("source_file", "kind", "seq", "blob").mapInArrow(run, _RECORD)


def _table(pairs: dict) -> Column:
    """A literal map; whole keys are longs."""
    return F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for pair in pairs.items() for x in pair])


def normal_model(raw: Column) -> Column:
    """A model's name by its display name: known ones, then names of the three vendors with dashes, else as it is; null if blank."""
    trimmed = F.nullif(F.trim(raw), F.lit(""))
    low = F.lower(trimmed)
    base = F.trim(F.regexp_extract(low, r"^[^(]*", 0))
    dashed = F.replace(base, F.lit(" "), F.lit("-"))
    effort = F.regexp_extract(low, r"^gemini (3\.[678]) flash \((high|medium|low)\)$", 1)
    return (
        F.when(effort != "", F.concat(F.lit("gemini-"), effort, F.lit("-flash-"), F.regexp_extract(low, r"\((\w+)\)$", 1)))
        .otherwise(F.coalesce(F.try_element_at(_table(NAMED), base), F.when(dashed.rlike("^(gemini|claude|gpt)-"), dashed), trimmed))
    )


def model_of_id(i: Column) -> Column:
    """A model's name by its number; null for null."""
    named = F.coalesce(F.try_element_at(_table(BY_ID), i), F.when(i >= 1000, F.concat(F.lit("model_placeholder_m"), i - 1000)).otherwise(F.concat(F.lit("antigravity-model-"), i)))
    return F.when(i.isNotNull(), normal_model(named))


def events(records: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, kind, seq, pos, session_id, model, provider, counters, ts_ms, ts_rank, identities) of the requests with tokens.

    records as decoded(); files has each database's fallback time. A database with a record that can't be read has none. A
    step without a model takes the last that a generation of its database names, a generation the one named before it. Times:
    the record's own (rank 3), the trajectory's (1), the file's (0).
    """
    bad = records.where("not ok").select("source_file").distinct()
    good = records.join(bad, "source_file", "left_anti").withColumn("named", F.coalesce(normal_model(F.col("model")), model_of_id(F.col("model_id"))))
    of_file = good.groupBy("source_file").agg(
        F.min_by(F.when(F.col("kind") == TRAJECTORY, F.col("at")), F.when((F.col("kind") == TRAJECTORY) & F.col("at").isNotNull(), F.col("seq"))).alias("trajectory"),
        F.max_by("named", F.when((F.col("kind") == GENERATION) & F.col("named").isNotNull(), F.col("seq"))).alias("last_named"),
    )
    own = F.coalesce("named", F.when(F.size("usages") > 0, model_of_id(F.get("usages", 0)["model_id"])))
    good = good.withColumn("carried", carried(F.when(F.col("kind") == GENERATION, own), ["source_file", "kind"], ["seq"]))
    rows = good.where(F.col("kind") != TRAJECTORY).join(of_file, "source_file").join(files, "source_file", "left")
    context = F.when(F.col("kind") == STEP, F.coalesce("named", "last_named")).otherwise(F.col("carried"))
    rows = rows.select("*", context.alias("context"), F.posexplode("usages").alias("pos", "u"))
    u = lambda k: F.coalesce(F.col("u")[k], F.lit(0).cast("long"))
    some = (u("input") > 0) | (u("total") > 0) | (u("created") > 0) | (u("read") > 0) | (u("reasoning") > 0) | (u("visible") > 0)
    total = F.greatest(u("total"), u("visible") + u("reasoning"))
    output = F.greatest(u("visible"), total - u("reasoning"))
    name = lambda kind, k: F.when(F.col("u")[k] != "", F.concat(F.lit(kind), F.col("u")[k]))
    rank = F.when(F.col("at").isNotNull(), 3).when(F.col("trajectory").isNotNull(), 1).otherwise(0)
    return rows.where(some).select(
        "source_file", "kind", "seq", "pos", F.regexp_replace(basename(F.col("source_file")), r"\.[^.]*$", "").alias("session_id"), F.coalesce(model_of_id(F.col("u.model_id")), "context", F.lit(DEFAULT)).alias("model"),
        F.coalesce("u.provider", "provider").alias("provider"), u("input").alias("input"), output.alias("output"), u("created").alias("created"), u("read").alias("read"),
        F.greatest(u("reasoning"), total - output).alias("reasoning"), total.alias("total"), F.coalesce("at", "trajectory", "mtime_ms", F.lit(0)).alias("ts_ms"), rank.alias("ts_rank"),
        F.array_compact(F.array(name("response:", "response"), name("provider:", "remote"), name("message:", "message"))).alias("identities"),
    )


def merged(found: DataFrame) -> DataFrame:
    """One row of the events that share an identity, directly or through others, over all databases.

    Counters are the greatest; the total is not less than output and reasoning together. The first event names session and
    provider, the first that knows its model the model; the time is that of the best rank, of these the earliest, so an event
    without a time takes that of another with its identity. Events without an identity stay alone.
    """
    place = F.struct("source_file", "kind", "seq", "pos")
    work = found.withColumn("id", F.concat_ws("|", "source_file", "kind", "seq", "pos"))
    edges = work.select("id", F.explode("identities").alias("identity")).select(F.concat(F.lit("e|"), "id").alias("a"), F.concat(F.lit("i|"), "identity").alias("b"))
    root = dedup.components(edges, "a", "b").where("node like 'e|%'").select(F.substring("node", 3, 1 << 30).alias("id"), "root")
    work = work.join(root, "id", "left").withColumn("root", F.coalesce("root", F.concat(F.lit("e|"), "id")))
    most = {c: F.max(c).alias(c) for c in ("input", "output", "created", "read", "reasoning")}
    first = lambda c, when: F.min_by(c, F.when(when, place)).alias(c)
    out = work.groupBy("root").agg(
        *most.values(), F.max("total").alias("most"), F.count("*").alias("n"), F.min(place).alias("place"), F.min_by("session_id", place).alias("session_id"),
        first("provider", F.col("provider").isNotNull()), first("model", F.col("model") != DEFAULT), F.min(F.struct((-F.col("ts_rank")).alias("r"), "ts_ms")).alias("time"),
    )
    total = F.when(F.col("n") > 1, F.greatest("most", F.col("output") + F.col("reasoning"))).otherwise(F.col("most"))
    return out.select(F.col("place.source_file").alias("source_file"), F.col("place.seq").alias("seq"), "session_id", F.coalesce("model", F.lit(DEFAULT)).alias("model"), "provider", *most, total.alias("total"), F.col("time.ts_ms").alias("ts_ms"))


def antigravity(spark: SparkSession, root: str) -> DataFrame:
    """Usage rows of all databases under a folder. An empty folder, or databases without these tables, give an empty table."""
    python_ready(spark)
    paths = databases(root, "*.db")
    read = lambda kind, sql: read_sqlite(spark, paths, [sql], "blob binary").withColumn("kind", F.lit(kind))
    rows = read(GENERATION, "SELECT data AS blob FROM gen_metadata ORDER BY idx").unionByName(read(STEP, "SELECT metadata AS blob FROM steps WHERE metadata IS NOT NULL ORDER BY idx"))
    rows = rows.unionByName(read(TRAJECTORY, "SELECT data AS blob FROM trajectory_metadata_blob ORDER BY rowid"))
    records, _ = written(decoded(rows), "antigravity")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").option("recursiveFileLookup", "true").load(root)
    files = listed.select(percent_decoded(F.regexp_replace("path", "^file:(//)?", "")).alias("source_file"), F.unix_millis("modificationTime").alias("mtime_ms"))
    found, _ = written(events(records, files), "antigravity-events")
    df = merged(found)
    flash = F.nullif(F.regexp_extract("model", r"^(gemini-3\.[678]-flash)-(high|medium|low)$", 1), F.lit(""))
    names = F.array_compact(F.array("model", flash))
    google = F.coalesce(F.col("provider").isin(*GOOGLE), F.lit(False))
    every = F.array_distinct(F.flatten(F.transform(names, lambda m: F.concat(F.array(m), F.when(google, F.array(*[F.concat(F.lit(f"{p}/"), m) for p in PREFIXES])).otherwise(F.array().cast("array<string>"))))))
    exact = flash.isNotNull()
    out = df.select(
        "source_file", "seq", "ts_ms", "session_id", F.lit("Antigravity").alias("project"), "model", F.col("input").alias("input_tokens"), F.col("output").alias("output_tokens"), F.col("created").alias("cache_creation_tokens"),
        F.col("read").alias("cache_read_tokens"), F.greatest(F.col("total") - F.col("output"), F.lit(0).cast("long")).alias("extra_tokens"), F.col("reasoning").alias("reasoning_tokens"),
        F.when(exact, every).alias("exact_candidates"), F.when(exact, F.array().cast("array<string>")).otherwise(every).alias("candidates"), exact.alias("ignores_time"),
    )
    return conform(out, "antigravity")
