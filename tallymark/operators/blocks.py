"""Billing blocks: stretches of at most `length` that begin at the full hour of their first request.

A block ends when a request comes more than `length` after its start, or more than `length` after the request
before. Where blocks begin depends only on which units of time hold requests, so requests are first summed by
account, unit and model (a map-side combined aggregation); the sequential part is then a fold over an account's
units, whose number is bounded by the time covered and not by the requests.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import HOUR_MS, round_half_up

LENGTH_MS = 5 * HOUR_MS
#: Counters of a block; extra tokens don't count there.
BLOCK_COUNTERS = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"]


def unit_of(length: int) -> int:
    """The unit of time within which no block can begin but at its start: blocks begin on the hour and last `length`."""
    return gcd(length, HOUR_MS)


def place_in_units(ts: Column, unit: int) -> Column:
    """Number of the unit a time falls in, doubled: a request at the very start of a unit may end the block before, one after it may not."""
    return 2 * F.floor(ts / unit).cast("long") + (F.pmod(ts, F.lit(unit)) > 0).cast("long")


def unit_sums() -> list[Column]:
    """Aggregates of the requests of one account, unit and model."""
    by_time = F.struct("ts_ms", "seq")
    return [
        *[F.sum(c).alias(c) for c in BLOCK_COUNTERS], F.sum(F.col("cost_pico").cast("decimal(38,0)")).alias("cost_pico"), F.count("*").alias("n_entries"),
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min(by_time)["seq"].alias("first_seq"),
        F.min_by("reset_ms", F.when(F.col("reset_ms").isNotNull(), by_time)).alias("reset_ms"),
    ]


def _cut(units: Column, length: int) -> Column:
    """Stretches (start_ms, rows) of an account's units, which are in order: a new one where a block begins."""

    def step(a: Column, u: Column) -> Column:
        new = a["start"].isNull() | (u["first_ms"] - a["start"] > length) | (u["first_ms"] - a["last"] > length)
        start = F.when(new, u["first_ms"] - F.pmod(u["first_ms"], F.lit(HOUR_MS))).otherwise(a["start"])
        mark = F.struct(a["n"].alias("n"), start.alias("start"))
        marks = F.when(a["start"].isNull() | (start != a["start"]), F.array_append(a["marks"], mark)).otherwise(a["marks"])
        return F.struct(start.alias("start"), F.greatest(a["last"], u["last_ms"]).alias("last"), (a["n"] + 1).alias("n"), marks.alias("marks"))

    none = F.lit(None).cast("long")
    zero = F.struct(none.alias("start"), none.alias("last"), F.lit(0).alias("n"), F.array().cast("array<struct<n:int,start:bigint>>").alias("marks"))

    def parts(a: Column) -> Column:
        after = F.concat(F.slice(F.transform(a["marks"], lambda m: m["n"]), F.lit(2), F.size(a["marks"])), F.array(F.size(units)))
        return F.zip_with(a["marks"], after, lambda m, end: F.struct(m["start"].alias("start_ms"), F.slice(units, m["n"] + 1, end - m["n"]).alias("rows")))

    return F.aggregate(units, zero, step, parts)


def blocks(usage: DataFrame, keys: list[str], length_ms: int = LENGTH_MS, now_ms: int | None = None, gaps: bool = True) -> DataFrame:
    """(keys, start_ms, end_ms, is_gap, first_ms, last_ms, n_entries, counters, cost_pico, models, reset_ms, is_active).

    models: in order of first use. A gap row stands between blocks whose requests are more than `length_ms`
    apart, from `length_ms` after the last request to the next. A block is active at now_ms if that is before
    its end and within `length_ms` of its last request. length_ms is a whole number of minutes or more.
    Requests without a time are in no block.
    """
    timed = usage.where("ts_ms is not null").withColumn("__u", place_in_units(F.col("ts_ms"), unit_of(length_ms)))
    fine = timed.groupBy(*keys, "__u", "model").agg(*unit_sums())
    row = F.struct("__u", "first_ms", "first_seq", "model", "last_ms", "n_entries", *BLOCK_COUNTERS, "cost_pico", "reset_ms")
    # An account's array has a row for each unit and model, however many requests there are.
    whole = fine.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("units"))
    cut = whole.select(*keys, F.explode(_cut(F.col("units"), length_ms)).alias("b")).select(*keys, "b.start_ms", F.explode("b.rows").alias("r"))
    out = cut.select(*keys, "start_ms", "r.*").groupBy(*keys, "start_ms").agg(
        *[F.sum(c).alias(c) for c in BLOCK_COUNTERS], F.sum("cost_pico").cast("decimal(38,0)").alias("cost_pico"), F.sum("n_entries").alias("n_entries"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.array_sort(F.collect_list(F.struct("first_ms", "first_seq", "model"))).alias("m"),
        F.min_by("reset_ms", F.when(F.col("reset_ms").isNotNull(), F.col("first_ms"))).alias("reset_ms"),
    )
    models = F.array_distinct(F.filter(F.transform("m", lambda x: x["model"]), lambda x: x.isNotNull()))
    active: Column = F.lit(False)
    if now_ms is not None:
        active = (F.lit(now_ms) - F.col("last_ms") < length_ms) & (F.lit(now_ms) < F.col("start_ms") + length_ms)
    cols = [*keys, "start_ms", "end_ms", "is_gap", "first_ms", "last_ms", "n_entries", *BLOCK_COUNTERS, "cost_pico", "models", "reset_ms", "is_active"]
    rows = out.withColumns({"end_ms": F.col("start_ms") + length_ms, "is_gap": F.lit(False), "models": models, "is_active": active}).select(*cols)
    if not gaps:
        return rows
    w = Window.partitionBy(*keys).orderBy("start_ms", "first_ms")
    after = rows.withColumn("__next", F.lead("first_ms").over(w)).where(F.col("__next") - F.col("last_ms") > length_ms)
    none = {c: F.lit(0).cast(rows.schema[c].dataType) for c in ["n_entries", *BLOCK_COUNTERS, "cost_pico"]}
    gap = after.withColumns({
        "start_ms": F.col("last_ms") + length_ms, "end_ms": F.col("__next"), "is_gap": F.lit(True), "is_active": F.lit(False),
        "models": F.array().cast("array<string>"), "reset_ms": F.lit(None).cast("long"), **none,
    }).withColumns({"first_ms": F.lit(None).cast("long"), "last_ms": F.lit(None).cast("long")})
    return rows.unionByName(gap.select(*cols))


def block_tokens() -> Column:
    out = F.col(BLOCK_COUNTERS[0])
    for c in BLOCK_COUNTERS[1:]:
        out = out + F.col(c)
    return out


def burn_rate(rows: DataFrame) -> DataFrame:
    """Blocks with tokens_per_minute and cost_per_hour over the time from first to last request; null without a span."""
    minutes = (F.col("last_ms") - F.col("first_ms")) / F.lit(60_000.0)
    live = ~F.col("is_gap") & (minutes > 0)
    per_min = F.when(live, block_tokens() / minutes)
    per_hour = F.when(live, F.col("cost_pico").cast("double") / F.lit(1e12) / minutes * 60)
    return rows.withColumns({"tokens_per_minute": per_min, "cost_per_hour": per_hour})


def projection(rows: DataFrame, now_ms: int) -> DataFrame:
    """burn_rate() with the totals that active blocks reach at their end at the present rate, rounded half up."""
    left = F.greatest((F.col("end_ms") - F.lit(now_ms)) / F.lit(60_000.0), F.lit(0.0))
    live = F.col("is_active") & F.col("tokens_per_minute").isNotNull()
    cost = F.col("cost_pico").cast("double") / F.lit(1e12) + F.col("cost_per_hour") / 60 * left
    return burn_rate(rows).withColumns({
        "remaining_minutes": F.when(live, round_half_up(left)), "projected_tokens": F.when(live, round_half_up(block_tokens() + F.col("tokens_per_minute") * left)),
        "projected_cost": F.when(live, F.floor(cost * 100 + 0.5) / 100),
    })


def limit_status(tokens: Column, limit: Column) -> Column:
    """exceeds over the limit, warning over 80 % of it, else ok; null without a limit."""
    return F.when(limit > 0, F.when(tokens > limit, F.lit("exceeds")).when(tokens > limit * 0.8, F.lit("warning")).otherwise(F.lit("ok")))


def largest_finished(rows: DataFrame) -> DataFrame:
    """One row with the most tokens of a block that is neither a gap nor active (0 without one)."""
    return rows.where(~F.col("is_gap") & ~F.col("is_active")).agg(F.coalesce(F.max(block_tokens()), F.lit(0)).alias("max_tokens"))
