"""Codex session logs: running totals of each file, forked sessions without what they replay, and headless records.

Files are joined by their lineage, which stands in their first lines: a forked session repeats its parent's events from the
first on, up to the time of the fork, or writes them anew in one burst. All windows are by file, so a task holds one log's
events at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import lenient_millis
from ..functions.text import non_empty
from ..operators import carry, dedup, joins
from ..operators.price_book import user_alias
from ..schema import conform
from ..scratch import written
from .files import first_lines, lines, listing, parsed, whole
from .pruning import threshold, with_parents

#: The model that reviews stand for from a day on, the newest first, and the model before all of them.
REVIEW_MODELS = [
    ("2026-07-30", "gpt-5.6-luna"), ("2026-03-05", "gpt-5.4"), ("2026-02-05", "gpt-5.3-codex"), ("2025-12-11", "gpt-5.2-codex"), ("2025-11-13", "gpt-5.1-codex"),
]
REVIEW, FALLBACK = "codex-auto-review", "gpt-5"
#: Names of the counters in logs, the first that is given counts.
NAMES = {
    "input": ["input_tokens", "prompt_tokens", "input"], "output": ["output_tokens", "completion_tokens", "output"], "reasoning": ["reasoning_output_tokens", "reasoning_tokens"],
    "cached": ["cached_input_tokens", "cache_read_input_tokens", "cached_tokens"], "written": ["cache_write_input_tokens", "cache_creation_input_tokens"], "total": ["total_tokens"],
}
COUNTS = ["input", "cached", "written", "output", "reasoning", "total"]
MARKERS = ['"turn_context"', '"token_count"', '"thread_settings_applied"', '"usage":', '"input_tokens":', '"prompt_tokens":']
#: Milliseconds between events of one burst at most.
PAUSE = 1000

_RAW = "struct<" + ", ".join(f"{n}: string" for names in NAMES.values() for n in names) + ">"
_NAMED = "model: string, model_name: string, metadata: struct<model: string>"
_HEADLESS = f"usage {_RAW}, model string, model_name string, metadata struct<model: string>, timestamp string, created_at string, createdAt string"
_INNER = f"usage: {_RAW}, {_NAMED}, timestamp: string, created_at: string, createdAt: string"
_DDL = (
    f"type string, {_HEADLESS}, data struct<{_INNER}>, result struct<{_INNER}>, response struct<{_INNER}>, payload struct<type: string, id: string, forked_from_id: string, "
    f"source: struct<subagent: struct<thread_spawn: struct<parent_thread_id: string>>>, {_NAMED}, thread_settings: struct<service_tier: string>, "
    f"info: struct<{_NAMED}, total_token_usage: {_RAW}, last_token_usage: {_RAW}>>"
)


def _count(x: Column) -> Column:
    n = x.try_cast("double")
    return F.when(n >= 0, F.floor(n)).cast("long")


def _usage(u: Column) -> Column:
    """Counters of a raw struct, null if there is none: cached and written tokens are parts of the input; a missing total is input and output."""
    zero = F.lit(0).cast("long")
    of = {k: F.coalesce(*[_count(u[n]) for n in names], zero) for k, names in NAMES.items()}
    cached = F.least(of["cached"], of["input"])
    total = F.when(of["total"] > 0, of["total"]).otherwise(of["input"] + of["output"])
    parts = {"input": of["input"], "cached": cached, "written": F.least(of["written"], of["input"] - cached), "output": of["output"], "reasoning": of["reasoning"], "total": total}
    return F.when(u.isNotNull(), F.struct(*[c.alias(k) for k, c in parts.items()]))


def _normal(u: Column) -> Column:
    cached = F.least(u["cached"], u["input"])
    return F.struct(u["input"].alias("input"), cached.alias("cached"), F.least(u["written"], u["input"] - cached).alias("written"), *[u[k].alias(k) for k in ("output", "reasoning", "total")])


def _model(x: Column) -> Column:
    return F.coalesce(non_empty(x["model"]), non_empty(x["model_name"]), non_empty(x["metadata"]["model"]))


def _millis(x: Column) -> Column:
    """Epoch ms of a text, or of a number of seconds or ms."""
    n = _count(x)
    return F.when(F.trim(x).rlike(r"^\d+(\.\d+)?$"), F.when(n > 10_000_000_000, n).otherwise(n * 1000)).otherwise(lenient_millis(F.trim(x)))


def _relative(path: Column, root: str) -> Column:
    """Path below `sessions` or `archived_sessions`, else below the root."""
    inside = F.replace(path, F.lit(root.removeprefix("file://").rstrip("/") + "/"), F.lit(""))
    return F.regexp_replace(inside, r"^(.*/)?(sessions|archived_sessions)/", "")


def lineage(rows: DataFrame, root: str) -> DataFrame:
    """(source_file, relative, parent_file, is_fork, forked_ms) of each file, from its first line; `rows` holds first lines with their JSON `j`.

    A file that stands archived at the same place counts once. A parent is the first file with the id, itself aside; a fork
    whose parent isn't there has none.
    """
    p = F.col("j.payload")
    meta = F.col("j.type") == "session_meta"
    parent = F.coalesce(non_empty(p["forked_from_id"]), non_empty(p["source"]["subagent"]["thread_spawn"]["parent_thread_id"]))
    files = rows.select("source_file", _relative(F.col("source_file"), root).alias("relative"), F.col("source_file").rlike("/archived_sessions/").alias("archived"), F.when(meta, p["id"]).alias("id"),
                        F.when(meta, parent).alias("parent"), _millis(F.col("j.timestamp")).alias("forked_ms"))
    files = dedup.first_by(files, ["relative"], ["archived", "source_file"])
    ids = files.where("id is not null").select(F.col("id").alias("parent"), F.col("source_file").alias("parent_file"), F.struct("archived", "source_file").alias("place"))
    found = files.join(ids, "parent").where("source_file <> parent_file").groupBy("source_file").agg(F.min_by("parent_file", "place").alias("parent_file"))
    return files.join(found, "source_file", "left").select("source_file", "relative", "parent_file", F.col("parent").isNotNull().alias("is_fork"), "forked_ms")


def events(rows: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """(source_file, seq, ts_ms, model, is_fallback, tier, counters, burst_ms) of each request, of parsed lines.

    An event takes the log's own last usage where its total moved, else the difference of the totals. Models are carried
    forward; where none was named yet the fallback counts, told on the first such row. A review stands for the model of its
    day. burst_ms: the time of a file's first event, if the second follows within a second.
    """
    p = F.col("j.payload")
    kind = lambda name: F.col("value").rlike(f'"type"\\s*:\\s*"{name}"')
    in_session = kind("turn_context") | (kind("event_msg") & (kind("token_count") | kind("thread_settings_applied")))
    event = in_session & (F.col("j.type") == "event_msg") & non_empty(F.col("j.timestamp")).isNotNull()
    token = F.coalesce(event & (p["type"] == "token_count"), F.lit(False))
    tier_set = event & (p["type"] == "thread_settings_applied") & p["thread_settings"]["service_tier"].isNotNull()
    tier = F.when(p["thread_settings"]["service_tier"].isin("default", "standard"), "standard").when(p["thread_settings"]["service_tier"].isin("fast", "priority"), "fast")
    levels = [F.col("j"), F.col("j.data"), F.col("j.result"), F.col("j.response")]
    marked = F.contains("value", F.lit('"usage":')) | F.contains("value", F.lit('"input_tokens":')) | F.contains("value", F.lit('"prompt_tokens":'))
    alone = F.when(~in_session & marked, F.coalesce(*[_usage(x["usage"]) for x in levels]))
    at = lambda f: F.coalesce(*[f(x[n]) for x in levels for n in ("timestamp", "created_at", "createdAt")])
    dated = lambda x: F.when(F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd").isNotNull(), F.trim(x)).otherwise(F.timestamp_millis(_millis(x)).cast("timestamp_ntz").cast("string"))
    w = Window.partitionBy("source_file").orderBy("seq")
    work = rows.withColumns({
        "token": token, "total": F.when(token, _usage(p["info"]["total_token_usage"])), "own": F.when(token, _usage(p["info"]["last_token_usage"])), "alone": alone,
        "ts_ms": F.when(token, _millis(F.col("j.timestamp"))).otherwise(F.coalesce(at(_millis), "mtime_ms")), "tier": carry.carried_struct(tier_set, tier, ["source_file"], ["seq"]),
        "day": F.substring(F.when(token, F.trim("j.timestamp")).otherwise(F.coalesce(at(dated), F.timestamp_millis("mtime_ms").cast("timestamp_ntz").cast("string"))), 1, 10),
    }).withColumn("prev", F.last("total", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    step = lambda k: F.greatest(F.col("total")[k] - F.coalesce(F.col("prev")[k], F.lit(0)), F.lit(0).cast("long")).alias(k)
    moved = F.col("total").isNull() | ~F.col("total").eqNullSafe(F.col("prev"))
    used = F.when(F.col("token"), _normal(F.coalesce(F.when(moved, F.col("own")), F.when(F.col("total").isNotNull(), F.struct(*map(step, COUNTS)))))).otherwise(F.col("alone"))
    work = work.withColumn("u", used)
    some = lambda ks: sum((F.coalesce(F.col("u")[k], F.lit(0)) for k in ks[1:]), F.coalesce(F.col("u")[ks[0]], F.lit(0))) > 0
    counts = F.when(F.col("token"), some(COUNTS[:5])).otherwise(some(COUNTS))
    named = F.when(F.col("token"), F.coalesce(_model(p), _model(p["info"]))).otherwise(F.coalesce(*[_model(x) for x in levels]))
    turn = F.when(in_session & (F.col("j.type") == "turn_context"), _model(p))
    work = work.withColumns({"counts": counts, "said": F.coalesce(turn, F.when(counts, named))})
    work = work.withColumn("current", F.last("said", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    started = F.when(F.col("token") & (F.col("own").isNotNull() | F.col("total").isNotNull()), F.col("ts_ms"))
    whole_file = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one, two = (F.nth_value(F.col("started"), n, True).over(whole_file) for n in (1, 2))
    work = work.withColumn("started", started).withColumns({"one": one, "gap": two - one}).where("counts")
    none = F.col("current").isNull()
    nth = F.sum(none.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    review = F.col("current") == REVIEW
    by_day = F.coalesce(*[F.when(F.col("day") >= since, F.lit(m)) for since, m in REVIEW_MODELS], F.lit(FALLBACK))
    by_day = F.when(F.try_to_date("day", "yyyy-MM-dd").isNotNull(), by_day).otherwise(F.lit(FALLBACK))
    return work.select(
        "source_file", "seq", "ts_ms", F.when(review, by_day).otherwise(F.coalesce("current", F.lit(fallback))).alias("model"), F.coalesce((none & (nth == 1)) | review, F.lit(False)).alias("is_fallback"),
        F.when(F.col("token"), F.col("tier")).alias("tier"), *[F.col("u")[k].alias(k) for k in COUNTS], F.when(F.col("gap").between(0, PAUSE), F.col("one")).alias("burst_ms"),
    )


def fast_by_config(spark: SparkSession, root: str) -> bool:
    """Whether config.toml of the root sets the fast tier for requests that don't name one."""
    at = root.removeprefix("file://").rstrip("/") + "/config.toml"
    setting = F.explode(F.transform(F.split("value", "\n"), lambda x: F.split(F.element_at(F.split(x, "#"), 1), "=", 2)))
    rows = whole(spark, root, "config.toml").where(F.col("source_file") == at).select(setting.alias("s")).where("size(s) = 2 and trim(s[0]) = 'service_tier'")
    return not rows.where(F.regexp_replace(F.trim(F.col("s")[1]), "^[\"']+|[\"']+$", "").isin("fast", "priority")).isEmpty()


def codex(spark: SparkSession, root: str, fallback_model: str = FALLBACK, user_aliases: dict[str, str] | None = None, by_session: bool = False, since: str | None = None) -> DataFrame:
    """Usage rows of session logs: forked sessions without what they repeat of their parent, equal requests once.

    `by_session`: equal requests of different sessions are kept, as a report by session needs them. `since` (a day): only files
    written since and the direct parents of those are read beyond their first line; rows of earlier days in them stay. Lines
    that aren't JSON objects, events without time and requests without tokens are dropped; an empty folder gives an empty table.
    """
    listed = listing(spark, root, "*.jsonl")
    first = first_lines(listed).withColumn("j", F.from_json("value", _DDL, {"mode": "PERMISSIVE"}))
    files, _ = written(lineage(first, root), "codex-files")
    rows = parsed(lines(spark, root, "*.jsonl", MARKERS, with_parents(listed, files, threshold(since))), _DDL)
    found, _ = written(events(rows, fallback_model), "codex-events")
    kept = joins.without_replayed(found.join(files, "source_file"), "source_file", "parent_file", "is_fork", "seq", COUNTS, "ts_ms", "forked_ms", "burst_ms", PAUSE)
    other = user_alias(F.col("model"), user_aliases or {})
    kept = kept.where("ts_ms is not null").withColumn("model", F.coalesce(other, "model"))
    session = F.regexp_replace("relative", r"\.jsonl$", "")
    fresh = F.greatest(F.col("input") - F.col("cached") - F.col("written"), F.lit(0).cast("long"))
    fast = F.coalesce(F.col("tier") != "standard", F.lit(True)) if fast_by_config(spark, root) else F.coalesce(F.col("tier") == "fast", F.lit(False))
    out = kept.select(
        "source_file", "seq", "ts_ms", session.alias("session_id"), F.lit("").alias("project"), "model", "is_fallback", fresh.alias("input_tokens"), F.col("output").alias("output_tokens"),
        F.col("written").alias("cache_creation_tokens"), F.col("cached").alias("cache_read_tokens"), (F.col("total") - fresh - F.col("output") - F.col("written") - F.col("cached")).alias("extra_tokens"),
        F.col("reasoning").alias("reasoning_tokens"), fast.alias("fast"), F.col("input").alias("__in"), F.col("total").alias("__total"),
    )
    keys = ["ts_ms", "model", "__in", "cache_read_tokens", "cache_creation_tokens", "output_tokens", "reasoning_tokens", "__total"] + (["session_id"] if by_session else [])
    return conform(dedup.first_by(out, keys, ["source_file", "seq"]), "codex")
