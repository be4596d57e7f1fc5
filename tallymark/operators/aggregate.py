"""Usage aggregation: periods, sessions, agents and models, with exact sums at every level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket, date_key
from ..schema import COUNTERS, total_tokens

#: Costs are summed in picodollars, exactly and in any order, and become dollars at the edge.
PICO = 1_000_000_000_000


def dollars(pico: Column) -> Column:
    return pico.cast("double") / F.lit(float(PICO))


def rounded_dollars(pico: Column) -> Column:
    """Dollars to six decimals, halves up, from whole picodollars: the same on every engine."""
    return F.floor((pico.cast("decimal(38,0)") + 500_000) / 1_000_000).cast("double") / F.lit(1e6)


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in COUNTERS] + [F.sum(F.col("cost_pico").cast("decimal(38,0)")).alias("cost_pico")]


def by_period(usage: DataFrame, period: str = "daily", zone: str = "UTC", first_day: int = 0, extra: list[str] | None = None) -> DataFrame:
    """(period, extra..., counters, cost_pico, total_tokens): usage by day, week or month and any further columns."""
    keyed = usage.withColumn("period", bucket(date_key(F.col("ts_ms"), zone), period, first_day))
    return keyed.groupBy("period", *(extra or [])).agg(*_sums()).withColumn("total_tokens", total_tokens())


def with_breakdowns(usage: DataFrame, period: str = "daily", zone: str = "UTC", first_day: int = 0) -> DataFrame:
    """Periods with models_used and model_breakdowns (by cost, dearest first; ties by name).

    One pass to (period, model), one small one to the period. Rows without a model count in the totals only.
    """
    fine = by_period(usage, period, zone, first_day, ["model"])
    entry = F.struct((-F.col("cost_pico")).alias("__order"), F.col("model"), *[F.col(c) for c in COUNTERS], "total_tokens", "cost_pico")
    named = F.when(F.col("model").isNotNull(), entry)
    out = fine.groupBy("period").agg(*_sums(), F.array_sort(F.collect_list(named)).alias("b"))
    pick = lambda x: F.struct(x["model"].alias("model"), *[x[c].alias(c) for c in COUNTERS], x["total_tokens"].alias("total_tokens"), x["cost_pico"].alias("cost_pico"), dollars(x["cost_pico"]).alias("cost"))
    return out.select(
        "period", *COUNTERS, total_tokens().alias("total_tokens"), "cost_pico", dollars(F.col("cost_pico")).alias("cost"),
        F.array_sort(F.transform("b", lambda x: x["model"])).alias("models_used"), F.transform("b", pick).alias("model_breakdowns"),
    )


def by_period_and_agent(usage: DataFrame, period: str = "daily", zone: str = "UTC") -> DataFrame:
    """The unified report: period rows with the agents' rows nested in them. Rows without tokens are dropped; weeks begin on Monday."""
    live = usage.where(total_tokens() > 0)
    fine = by_period(live, period, zone, 1, ["agent", "model"])
    agents = fine.groupBy("period", "agent").agg(*_sums(), F.array_sort(F.collect_set("model")).alias("models_used"))
    one = F.struct("agent", *COUNTERS, total_tokens().alias("total_tokens"), "models_used", "cost_pico", dollars(F.col("cost_pico")).alias("cost"))
    out = agents.groupBy("period").agg(
        *_sums(), F.array_sort(F.array_distinct(F.flatten(F.collect_list("models_used")))).alias("models_used"),
        F.array_sort(F.collect_set("agent")).alias("agents"), F.array_sort(F.collect_list(one)).alias("agent_breakdowns"),
    )
    return out.select("period", *COUNTERS, total_tokens().alias("total_tokens"), "cost_pico", dollars(F.col("cost_pico")).alias("cost"), "agents", "models_used", "agent_breakdowns")


def sessions(usage: DataFrame) -> DataFrame:
    """(project, session_id) rows: sums, first and last time, the last request's model (first of equal times), sorted versions."""
    last = F.struct("ts_ms", (-F.col("seq")).alias("back"))
    out = usage.groupBy("project", "session_id").agg(
        *_sums(), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.max_by("model", last).alias("last_model"),
        F.array_sort(F.collect_set("model")).alias("models_used"), F.array_sort(F.collect_set("version")).alias("versions"), F.count("*").alias("n_entries"),
    )
    return out.withColumn("total_tokens", total_tokens())


def last_activity_filter(session_rows: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sessions by the text of their last activity in UTC. `until` (YYYYMMDD) leaves out the day itself: a time on it is a longer, greater text."""
    stamp = F.regexp_replace(F.date_format(F.timestamp_millis("last_ms").cast("timestamp_ntz"), "yyyyMMdd'T'HH:mm:ss.SSS'Z'"), "-", "")
    keep = F.lit(True)
    if since:
        keep = keep & (stamp >= since)
    if until:
        keep = keep & (stamp <= until)
    return session_rows.where(keep)


def rebucket(daily: DataFrame, period: str, first_day: int = 0) -> DataFrame:
    """Weeks or months from daily rows (columns of by_period without extra keys)."""
    key = bucket(F.col("period"), period, first_day)
    return daily.groupBy(key.alias("period")).agg(*_sums()).withColumn("total_tokens", total_tokens())


def grand_totals(usage: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals without keys, or the rollup over keys with the grand total in the row of nulls."""
    grouped = usage.rollup(*keys) if keys else usage.groupBy()
    return grouped.agg(*_sums(), F.count("*").alias("n_entries")).withColumn("total_tokens", total_tokens())
