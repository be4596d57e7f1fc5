"""Pricing as column expressions over usage joined with a broadcast rate table. Rates are whole picodollars a token."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that stand for others.
ALIASES = {"gpt-reserve": "gpt-5.6-luna", "gpt-5.6": "gpt-5.6-sol", "gpt-5.3-spark": "gpt-5.3-codex-spark"}
#: Dollars per million tokens (input, output, cache write, cache read), as published by the vendors.
RATES = {
    "claude-opus-4-5": (5, 25, 6.25, 0.5), "claude-opus-4-6": (5, 25, 6.25, 0.5), "claude-opus-4-7": (5, 25, 6.25, 0.5), "claude-opus-4-8": (5, 25, 6.25, 0.5),
    "claude-haiku-4-5": (1, 5, 1.25, 0.1), "claude-opus-4": (15, 75, 18.75, 1.5), "claude-sonnet-4-6": (3, 15, 3.75, 0.3), "claude-sonnet-4": (3, 15, 3.75, 0.3),
    "claude-3-5-haiku": (0.8, 4, 1, 0.08), "claude-3-5-haiku-20241022": (0.8, 4, 1, 0.08), "claude-3-opus": (15, 75, 18.75, 1.5),
    "claude-3-sonnet": (3, 15, 3.75, 0.3), "claude-3-haiku": (0.25, 1.25, 0.3, 0.03),
    "gpt-5": (1.25, 10, 1.25, 0.125), "gpt-5.1": (1.25, 10, 1.25, 0.125), "gpt-5.1-codex": (1.25, 10, 1.25, 0.125), "gpt-5.2": (1.75, 14, 1.75, 0.175),
    "gpt-5.2-codex": (1.75, 14, 1.75, 0.175), "gpt-5.3-codex": (1.75, 14, 1.75, 0.175), "gpt-5.4": (2.5, 15, 2.5, 0.25), "gpt-5.4-mini": (0.75, 4.5, 0.75, 0.075),
    "gpt-5.4-nano": (0.2, 1.25, 0.2, 0.02), "gpt-5.5": (5, 30, 5, 0.5), "gpt-5.6-sol": (5, 30, 6.25, 0.5), "gpt-5.6-terra": (2.5, 15, 3.125, 0.25),
    "gpt-5.6-luna": (1, 6, 1.25, 0.1), "grok-4.3": (1.25, 2.5, 1.25, 0.125), "moonshot/kimi-k2.5": (0.6, 3, 0.75, 0.1), "moonshot/kimi-k2.6": (0.95, 4, 1.1875, 0.16),
    "glm-4.5": (0.6, 2.2, 0, 0.11), "glm-4.6": (0.6, 2.2, 0, 0.11), "glm-4.7": (0.6, 2.2, 0, 0.11), "glm-5": (1, 3.2, 0, 0.2), "glm-5-turbo": (1.2, 4, 0, 0.24),
    "glm-5.1": (1.4, 4.4, 0, 0.26), "zai/glm-4.5": (0.6, 2.2, 0, 0.11), "zai/glm-4.5-x": (2.2, 8.9, 0, 0.45), "zai/glm-4.5-air": (0.2, 1.1, 0, 0.03),
    "zai/glm-4.5-airx": (1.1, 4.5, 0, 0.22), "zai/glm-4.5v": (0.6, 1.8, 0, 0.11), "zai/glm-4-32b-0414-128k": (0.1, 0.1, 0, 0), "zai/glm-4.5-flash": (0, 0, 0, 0),
}
#: Rates beyond 200,000 tokens of a counter.
ABOVE = {"claude-sonnet-4": (6, 22.5, 7.5, 0.6)}
#: What a request in the fast tier costs, as a multiple.
FAST_EXACT = {"gpt-5.6-sol": 2.0, "gpt-5.6-terra": 2.0, "gpt-5.6-luna": 2.0, "gpt-5.5": 2.5, "gpt-5.4": 2.0, "gpt-5.3-codex": 2.0, "gpt-6-astra": 2.0}
FAST_PREFIX = {"claude-opus-4-6": 6.0, "claude-opus-4-7": 6.0, "claude-opus-4-8": 2.0}
#: Fixed values: (model, from this epoch ms, off-peak rates, peak rates) in dollars per million tokens.
SCHEDULE = [
    ("deepseek-v4-flash", None, (0.14, 0.28, 0.14, 0.0028), None),
    ("deepseek-v4-flash", 1_786_896_000_000, (0.22, 0.66, 0.22, 0.007), (0.44, 1.32, 0.44, 0.014)),
    ("deepseek-v4-flash", "2026-09-10", (0.15, 0.6, 0.15, 0.003), (0.3, 1.2, 0.3, 0.006)),
    ("deepseek-v4-flash-vision-exp", None, (0.22, 0.66, 0.22, 0.007), (0.44, 1.32, 0.44, 0.014)),
    ("deepseek-v4-flash-vision-exp", "2026-09-10", (0.15, 0.6, 0.15, 0.003), (0.3, 1.2, 0.3, 0.006)),
    ("deepseek-flash", None, (0.15, 0.6, 0.15, 0.003), (0.3, 1.2, 0.3, 0.006)),
    ("deepseek-v4-pro", None, (0.435, 0.87, 0.435, 0.003625), None),
    ("deepseek-v4-pro", 1_786_896_000_000, (0.66, 1.98, 0.66, 0.022), (1.32, 3.96, 1.32, 0.044)),
]
LONG_CONTEXT = 200_000
KINDS = ["input", "output", "create", "read"]
RATE_DDL = (
    "price_model string, " + ", ".join(f"{k}_rate long" for k in KINDS) + ", " + ", ".join(f"{k}_above long" for k in KINDS)
    + ", threshold long, read_explicit boolean, fast_multiplier double"
)


def pico(per_million: float | None) -> int | None:
    """Dollars per million tokens as picodollars a token."""
    return None if per_million is None else round(per_million * 1_000_000)


def fast_multiplier(model: str) -> float:
    """By the name or its alias, else by a part of its path (cut at `/` and `:`): so, or by a base name that ends it or stands before a dash."""
    for name in dict.fromkeys([model, *re.split("[/:]", model)]):
        for known in (name, ALIASES.get(name)):
            if known in FAST_EXACT:
                return FAST_EXACT[known]
        plain = name.replace(".", "-").replace("@", "-")
        for base, m in FAST_PREFIX.items():
            _, found, after = plain.rpartition(base)
            if found and after[:1] in ("", "-"):
                return m
    return 1.0


def rate_rows(rates: dict | None = None, above: dict | None = None, overrides: dict[str, dict] | None = None) -> list[tuple]:
    """Rows of RATE_DDL. An override patches a row by field, or makes one if it has input and output (write 1.25, read 0.1 of input)."""
    rates, above = dict(RATES if rates is None else rates), dict(ABOVE if above is None else above)
    for name, _, off, _ in SCHEDULE:
        rates.setdefault(name, off)
    rows = {}
    for m, r in rates.items():
        rows[m] = {"rates": [pico(x) for x in r], "above": [pico(x) for x in above.get(m, (None,) * 4)], "threshold": None, "explicit": True, "fast": fast_multiplier(m)}
    for m, o in (overrides or {}).items():
        row = rows.get(m)
        if row is None:
            if "input" not in o or "output" not in o:
                continue
            row = {"rates": [pico(o["input"]), pico(o["output"]), pico(o["input"] * 1.25), pico(o["input"] * 0.1)], "above": [None] * 4, "threshold": None, "explicit": "read" in o, "fast": 1.0}
        row = {**row, "rates": [pico(o[k]) if k in o else v for k, v in zip(KINDS, row["rates"], strict=True)]}
        row["above"] = [pico(o[f"{k}_above"]) if f"{k}_above" in o else v for k, v in zip(KINDS, row["above"], strict=True)]
        row["threshold"], row["fast"] = o.get("threshold", row["threshold"]), o.get("fast_multiplier", row["fast"])
        rows[m] = row
    return [(m, *r["rates"], *r["above"], r["threshold"], r["explicit"], r["fast"]) for m, r in sorted(rows.items())]


def rate_table(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rate_rows() if rows is None else rows, RATE_DDL)


def priced_rows(usage: DataFrame, rates: DataFrame, on: str = "model") -> DataFrame:
    """usage with its rate columns (null without a price). The rate table is a price list: broadcast, as its size is that of the catalogue."""
    return usage.join(F.broadcast(rates), F.col(on) == F.col("price_model"), "left")


def _tiered(tokens: Column, base: Column, above: Column) -> Column:
    over = above.isNotNull() & (tokens > LONG_CONTEXT)
    return F.when(over, F.lit(LONG_CONTEXT) * base + (tokens - LONG_CONTEXT) * above).otherwise(tokens * base)


def cost_by_bucket(one_hour: Column | None = None) -> Column:
    """Picodollars: each counter's tokens beyond 200,000 at the above-rate; 1-hour cache writes at twice the input rate."""
    hour = F.lit(0).cast("long") if one_hour is None else F.coalesce(one_hour, F.lit(0).cast("long"))
    return (
        _tiered(F.col("input_tokens"), F.col("input_rate"), F.col("input_above")) + _tiered(F.col("output_tokens"), F.col("output_rate"), F.col("output_above"))
        + _tiered(F.col("cache_creation_tokens") - hour, F.col("create_rate"), F.col("create_above"))
        + _tiered(hour, F.col("input_rate") * 2, F.col("input_above") * 2) + _tiered(F.col("cache_read_tokens"), F.col("read_rate"), F.col("read_above"))
    )


def cost_by_request(threshold: Column, one_hour: Column | None = None) -> Column:
    """Picodollars: all counters at the above-rates when input, cache reads and writes together pass the threshold."""
    hour = F.lit(0).cast("long") if one_hour is None else F.coalesce(one_hour, F.lit(0).cast("long"))
    long = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens") > threshold
    rate = lambda k: F.when(long, F.coalesce(f"{k}_above", f"{k}_rate")).otherwise(F.col(f"{k}_rate"))
    return (
        F.col("input_tokens") * rate("input") + F.col("output_tokens") * rate("output") + (F.col("cache_creation_tokens") - hour) * rate("create")
        + hour * rate("input") * 2 + F.col("cache_read_tokens") * rate("read")
    )


def cost_codex(request_input: Column, fast: Column, threshold: Column | None = None) -> Column:
    """Picodollars by request input against a threshold; cache reads at the input rate unless the list has their own; fast multiplies."""
    long = F.coalesce(request_input, F.lit(0)) > (F.lit(LONG_CONTEXT) if threshold is None else F.coalesce(threshold, F.lit(LONG_CONTEXT)))
    rate = lambda k: F.when(long, F.coalesce(f"{k}_above", f"{k}_rate")).otherwise(F.col(f"{k}_rate"))
    read = F.when(F.col("read_explicit"), rate("read")).otherwise(rate("input"))
    cost = F.col("input_tokens") * rate("input") + F.col("cache_read_tokens") * read + F.col("cache_creation_tokens") * rate("create") + F.col("output_tokens") * rate("output")
    return F.when(fast, F.floor(cost * F.col("fast_multiplier") + 0.5).cast("long")).otherwise(cost)


def billed(usage: DataFrame, create_as_input: Column | None = None, extra_as_output: Column | None = None) -> DataFrame:
    """usage with cache writes counted as input, or extra tokens as output, where the flags say so."""
    c = F.coalesce(create_as_input, F.lit(False)) if create_as_input is not None else F.lit(False)
    e = F.coalesce(extra_as_output, F.lit(False)) if extra_as_output is not None else F.lit(False)
    zero = F.lit(0).cast("long")
    return usage.withColumns({
        "input_tokens": F.col("input_tokens") + F.when(c, F.col("cache_creation_tokens")).otherwise(zero),
        "cache_creation_tokens": F.when(c, zero).otherwise(F.col("cache_creation_tokens")),
        "output_tokens": F.col("output_tokens") + F.when(e, F.col("extra_tokens")).otherwise(zero),
    })


def is_peak(ts_ms: Column) -> Column:
    """Monday to Friday, 01-04 and 06-10 UTC."""
    day = F.floor(ts_ms / 86_400_000)
    hour = F.floor(F.pmod(ts_ms, F.lit(86_400_000)) / 3_600_000)
    return F.pmod(day + 4, F.lit(7)).between(1, 5) & (hour.between(1, 3) | hour.between(6, 9))


def era_start(value) -> int:
    """Epoch ms of the start of an era of SCHEDULE."""
    from datetime import UTC, datetime

    if value is None:
        return -(2**62)
    return value if isinstance(value, int) else int(datetime.fromisoformat(value).replace(tzinfo=UTC).timestamp() * 1000)


def schedule_table(spark: SparkSession, schedule: list | None = None) -> DataFrame:
    """(s_model, from_ms, to_ms, and off-peak and peak rate of each kind), one row an era."""
    by: dict[str, list] = {}
    for m, start, off, peak in SCHEDULE if schedule is None else schedule:
        by.setdefault(m, []).append((era_start(start), off, peak or off))
    rows = []
    for m, eras in by.items():
        eras.sort(key=lambda e: e[0])
        for k, (start, off, peak) in enumerate(eras):
            rows.append((m, start, eras[k + 1][0] if k + 1 < len(eras) else 2**62, *map(pico, off), *map(pico, peak)))
    ddl = "s_model string, from_ms long, to_ms long, " + ", ".join(f"{k}_{p} long" for p in ("off", "peak") for k in KINDS)
    return spark.createDataFrame(rows, ddl)


def scheduled(priced: DataFrame, schedule: DataFrame, on: str = "model") -> DataFrame:
    """priced_rows() with the rates of the era and time of day where the model has a schedule; above-rates are the same then."""
    j = priced.join(F.broadcast(schedule), (F.translate(on, ".@", "--") == F.translate("s_model", ".@", "--")) & (F.col("ts_ms") >= F.col("from_ms")) & (F.col("ts_ms") < F.col("to_ms")), "left")
    on_it = F.col("s_model").isNotNull() & F.col("price_model").isNotNull()
    now = lambda k: F.when(is_peak(F.col("ts_ms")), F.col(f"{k}_peak")).otherwise(F.col(f"{k}_off"))
    out = j.withColumns({f"{k}_{s}": F.when(on_it, now(k)).otherwise(F.col(f"{k}_{s}")) for k in KINDS for s in ("rate", "above")})
    return out.select(*priced.columns)


def with_cost(usage: DataFrame, rates: DataFrame, schedule: DataFrame | None = None, mode: str = "auto", on: str = "model", one_hour: Column | None = None, codex: Column | None = None) -> DataFrame:
    """usage with cost_pico and missing_pricing.

    Rows where `codex` holds are priced by cost_codex(), on the whole input of the request.

    mode: `display` takes the recorded cost_usd or 0, `auto` the recorded one if there is one, `calculate` always
    computes. No model: cost 0, nothing missing. A model without a price: cost 0, and missing if it has tokens.
    Fast requests cost the model's multiple.
    """
    rows = priced_rows(usage, rates, on)
    if schedule is not None:
        rows = scheduled(rows, schedule, on)
    plain = F.when(F.col("threshold").isNotNull(), cost_by_request(F.col("threshold"), one_hour)).otherwise(cost_by_bucket(one_hour))
    plain = F.when(F.col("fast"), F.floor(plain * F.col("fast_multiplier") + 0.5).cast("long")).otherwise(plain)
    if codex is not None:
        asked = F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")
        plain = F.when(codex, cost_codex(asked, F.coalesce("fast", F.lit(False)), F.col("threshold"))).otherwise(plain)
    recorded = F.floor(F.col("cost_usd") * F.lit(1e12) + 0.5).cast("long")
    computed = F.coalesce(plain, F.lit(0).cast("long"))
    cost = {"display": F.coalesce(recorded, F.lit(0).cast("long")), "auto": F.coalesce(recorded, computed), "calculate": computed}[mode]
    tokens = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens") + F.col("extra_tokens")
    missing = F.col(on).isNotNull() & F.col("price_model").isNull() & (tokens > 0)
    if mode == "display":
        missing = F.lit(False)
    elif mode == "auto":
        missing = missing & F.col("cost_usd").isNull()
    return rows.select(*usage.columns, cost.alias("cost_pico"), missing.alias("missing_pricing"))


def best_candidate(usage: DataFrame, rates: DataFrame, key: list[str], overrides: list[str] | None = None) -> DataFrame:
    """(key, price_model, cost_pico): of each row's ordered `candidates` the first with a positive cost.

    Overridden names count first, then names with a provider, then bare ones, each in their order; if none costs
    anything, the first that has a price. Rows whose candidates have no price are left out.
    """
    exploded = usage.select("*", F.posexplode("candidates").alias("pos", "candidate"))
    rank = F.when(F.col("candidate").isin(overrides or []), 0).when(F.contains("candidate", F.lit("/")), 1).otherwise(2)
    rows = priced_rows(exploded, rates, "candidate").where("price_model is not null").withColumn("cost_pico", cost_by_bucket())
    order = F.struct((F.col("cost_pico") <= 0).alias("none"), rank.alias("rank"), "pos")
    return rows.groupBy(*key).agg(F.min_by(F.struct("price_model", "cost_pico"), order).alias("b")).select(*key, "b.price_model", "b.cost_pico")


def consensus(rates: DataFrame) -> DataFrame:
    """(tail, price_model, n): of `provider/model` rows the rates that most providers list, ties to the shorter name."""
    tail = F.regexp_extract("price_model", r"/([^/]+)$", 1)
    rows = rates.where(F.contains("price_model", F.lit("/"))).select(tail.alias("tail"), "price_model", "input_rate", "output_rate", "read_rate")
    by = rows.groupBy("tail", "input_rate", "output_rate", "read_rate").agg(F.count("*").alias("n"), F.min(F.struct(F.length("price_model").alias("l"), "price_model")).alias("k"))
    return by.groupBy("tail").agg(F.max_by(F.struct(F.col("k.price_model").alias("price_model"), "n"), F.struct("n", (-F.col("k.l")).alias("l"))).alias("b")).select("tail", "b.price_model", "b.n")
