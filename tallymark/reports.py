"""The report API: usage rows in, report rows out, and their JSON for the small final results."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dates import bucket, date_key, day_start_ms
from .operators import aggregate, blocks, price_book, price_rows
from .schema import COUNTERS, total_tokens

#: Keys that a report without cost leaves out.
COST_KEYS = ("totalCost", "costUSD", "cost")
NAMES = {"input_tokens": "inputTokens", "output_tokens": "outputTokens", "cache_creation_tokens": "cacheCreationTokens", "cache_read_tokens": "cacheReadTokens", "extra_tokens": "extraTotalTokens"}


@dataclass
class Options:
    """Bounds and shaping of a report; dates are YYYYMMDD or YYYY-MM-DD, inclusive, in the zone."""

    since: str | None = None
    until: str | None = None
    zone: str = "UTC"
    mode: str = "auto"
    first_day: int = 0
    descending: bool = False


def since_of_last(period: str, n: int, today: str, first_day: int = 1) -> str:
    """First day (YYYY-MM-DD) of the last n periods, the present one counted."""
    from datetime import date, timedelta

    d = date.fromisoformat(today)
    if period == "daily":
        return (d - timedelta(days=n - 1)).isoformat()
    if period == "weekly":
        start = d - timedelta(days=(d.isoweekday() % 7 - first_day) % 7)
        return (start - timedelta(weeks=n - 1)).isoformat()
    months = d.year * 12 + d.month - 1 - (n - 1)
    return date(months // 12, months % 12 + 1, 1).isoformat()


def in_range(usage: DataFrame, o: Options, at: str = "ts_ms") -> DataFrame:
    """Rows whose day in the zone lies in the bounds; told by their time alone, so that the bounds reach the scan."""
    if o.since:
        usage = usage.where(F.col(at) >= day_start_ms(o.since, o.zone))
    if o.until:
        usage = usage.where(F.col(at) < day_start_ms(o.until, o.zone, plus=1))
    return usage


def price(
    usage: DataFrame, rates: DataFrame | price_book.Book | None = None, mode: str = "auto", aliases: dict[str, str] | None = None, overrides: dict[str, dict] | list[str] | None = None,
) -> DataFrame:
    """usage with cost_pico and missing_pricing: priced by a row's candidates or model, by rate, era and time of day.

    `rates` is a book of layered lists, a flat rate table, or nothing for the library's own rates. `overrides` are the rates
    that the user set, by name: they patch a flat table's rows, count before other candidates and hold in every era. Names
    alone say which rows of `rates` are the user's. `aliases` are the user's other names for models.
    """
    spark = usage.sparkSession
    own = overrides if isinstance(overrides, dict) else {n: {} for n in overrides or ()}
    if isinstance(rates, price_book.Book):
        of = rates
    elif rates is None:
        of = price_book.book(spark, overrides=own, user_aliases=aliases)
    else:
        of = price_book.flat_book(rates, own, aliases)
    return price_rows.price(usage, of, mode)


def periods(priced: DataFrame, period: str = "daily", o: Options = Options()) -> DataFrame:  # noqa: B008
    """One agent's report by day, week or month, with model breakdowns. Days are filtered before they are bucketed."""
    rows = aggregate.with_breakdowns(in_range(priced, o), period, o.zone, o.first_day)
    return rows.orderBy(F.desc("period") if o.descending else F.asc("period"))


def by_model(priced: DataFrame, period: str = "daily", o: Options = Options()) -> DataFrame:  # noqa: B008
    """One agent's report with a record for each model of a period: (period, sums, cost, last_ms, models by name).

    period: daily, weekly (from Monday), monthly or session. A model's record tells whether the model of any of its requests
    was a fallback, and whether any lacks a price. Two aggregations; a period nests one row a model.
    """
    rows = in_range(priced, o)
    key = F.col("session_id") if period == "session" else bucket(date_key(F.col("ts_ms"), o.zone), period, 1)
    counts = [*COUNTERS, "reasoning_tokens"]
    flag = lambda c: F.max(F.coalesce(F.col(c), F.lit(False)))
    each = rows.withColumn("total_tokens", total_tokens()).groupBy(key.alias("period"), "model").agg(
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in (*counts, "total_tokens")], F.sum("cost_pico").alias("cost_pico"), F.max("ts_ms").alias("last_ms"),
        flag("is_fallback").alias("is_fallback"), flag("missing_pricing").alias("missing_pricing"),
    )
    model = F.struct("model", *counts, "total_tokens", "is_fallback", "missing_pricing")
    out = each.groupBy("period").agg(*[F.sum(c).alias(c) for c in (*counts, "total_tokens", "cost_pico")], F.max("last_ms").alias("last_ms"), F.array_sort(F.collect_list(model)).alias("models"))
    out = out.withColumn("cost", aggregate.dollars(F.col("cost_pico")))
    return out.orderBy(F.desc("period") if o.descending else F.asc("period"))


def unified(priced: DataFrame, period: str = "daily", o: Options = Options()) -> DataFrame:  # noqa: B008
    """The report over all agents, agents nested in their period."""
    rows = aggregate.by_period_and_agent(in_range(priced, o), period, o.zone)
    return rows.orderBy(F.desc("period") if o.descending else F.asc("period"))


def sessions(priced: DataFrame, o: Options = Options()) -> DataFrame:  # noqa: B008
    """Sessions, the dearest first; bounds apply to the text of the last activity in UTC."""
    rows = aggregate.last_activity_filter(aggregate.sessions(priced), (o.since or "").replace("-", "") or None, (o.until or "").replace("-", "") or None)
    return rows.orderBy(F.desc("cost_pico"), "session_id", "project")


def session_detail(priced: DataFrame, session_id: str) -> DataFrame:
    return priced.where(F.col("session_id") == session_id).orderBy("ts_ms", "source_file", "seq")


def billing_blocks(priced: DataFrame, now_ms: int, keys: list[str] | None = None, hours: float = 5, active: bool = False, recent: bool = False, o: Options = Options()) -> DataFrame:  # noqa: B008
    """Blocks with burn rate and projection, in order of their start; bounds apply to the day of the start, `recent`: of the last three days or active."""
    if hours <= 0:
        raise ValueError("the length of a block must be positive")
    keys = keys or ["agent"]
    rows = blocks.blocks(priced, keys, int(hours * 3_600_000), now_ms)
    rows = in_range(blocks.projection(blocks.burn_rate(rows), now_ms), o, "start_ms")
    if recent:
        rows = rows.where((F.col("start_ms") >= now_ms - 3 * 86_400_000) | F.col("is_active"))
    rows = rows.where("is_active") if active else rows
    return rows.orderBy(F.desc("start_ms") if o.descending else F.asc("start_ms"), *keys)


def totals(priced: DataFrame) -> DataFrame:
    """One row: sums, cost and the sorted models without a price."""
    out = priced.agg(*[F.sum(c).alias(c) for c in COUNTERS], F.sum(F.col("cost_pico").cast("decimal(38,0)")).alias("cost_pico"),
                     F.array_sort(F.collect_set(F.when(F.col("missing_pricing"), F.col("model")))).alias("unpriced_models"))
    return out.select(*COUNTERS, total_tokens().alias("total_tokens"), aggregate.dollars(F.col("cost_pico")).alias("cost"), "unpriced_models")


def _shaped(v, cost: bool):
    if isinstance(v, dict):
        return {NAMES.get(k, _camel(k)): _shaped(x, cost) for k, x in v.items() if k != "cost_pico" and (cost or _camel(k) not in COST_KEYS)}
    if isinstance(v, (list, tuple)):
        return [_shaped(x, cost) for x in v]
    if isinstance(v, float) and (math.isnan(v) or v == int(v)):
        return None if math.isnan(v) else int(v)
    return v


def _camel(name: str) -> str:
    head, *tail = name.split("_")
    return head + "".join(t.title() for t in tail)


def to_json(report: DataFrame, total: DataFrame | None = None, name: str = "daily", cost: bool = True) -> str:
    """The report as JSON with sorted keys and two spaces; for report rows, whose number is that of periods or sessions shown."""
    rows = [_shaped(r.asDict(recursive=True), cost) for r in report.collect()]
    out = {name: rows}
    if total is not None:
        out["totals"] = _shaped(total.first().asDict(recursive=True), cost)
    return json.dumps(out, sort_keys=True, indent=2, default=str)
