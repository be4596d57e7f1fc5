"""Usage rows priced through a book: each distinct list of names is resolved once, and rows meet the result in one join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import pricing_key, without_date
from ..scratch import written
from .price_book import CATALOGUE, PATCHES, Book, _alias, resolve_names, user_alias
from .pricing import KINDS, LONG_CONTEXT, is_peak

#: Distinct lists of names up to which their prices are broadcast; a list with its prices takes about 1 KB.
BROADCAST_LISTS = 20_000
_TOKENS = dict(zip(KINDS, ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"], strict=True))
_RATES = [*[f"{k}_rate" for k in KINDS], *[f"{k}_above" for k in KINDS]]
_ERA = [*[f"{k}_off" for k in KINDS], *[f"{k}_peak" for k in KINDS]]


def _have(usage: DataFrame, name: str, kind: str, default) -> Column:
    """A column of the usage table that may be missing, nulls as the default."""
    return F.coalesce(F.col(name), F.lit(default).cast(kind)) if name in usage.columns else F.lit(default).cast(kind)


def name_lists(usage: DataFrame) -> Column:
    """The names that may price a row: those that count if the user overrides them, those that count if listed exactly, and the others.

    The others are the candidates, also where there are none of them, and the model where candidates are null.
    """
    names = lambda c: F.coalesce(F.array_compact(c), F.array().cast("array<string>")) if c in usage.columns else F.array().cast("array<string>")
    model = F.array_compact(F.array("model"))
    own = F.coalesce(F.array_compact("candidates"), model) if "candidates" in usage.columns else model
    return F.struct(names("override_candidates").alias("overridden"), names("exact_candidates").alias("listed"), own.alias("others"))


def price_lists(lists: DataFrame, of: Book) -> DataFrame:
    """(list, prices) of distinct lists: the prices of their names in the order in which they count.

    Names that resolve without a fuzzy match go first: overridden ones, then those with a provider, then bare ones, each in
    their order. Only if there are none, fuzzy matches count, in the names' order. A name that the user overrides or that is
    listed exactly may stand in its list for that case only. A price has its rates, the eras of its schedule by the name or
    the user's other name for it, and what the overrides set in an era.
    """
    of_kind = lambda i, names: F.transform(names, lambda n: F.struct(n.alias("model"), F.lit(i).alias("kind")))
    every = F.concat(*[of_kind(i, F.col("list")[k]) for i, k in enumerate(("overridden", "listed", "others"))])
    each = lists.select("list", F.posexplode(every).alias("pos", "e")).select("list", "pos", "e.*")
    patched = of.overrides.select(F.col("name").alias("__o"), "patch")
    found, _ = written(resolve_names(each, of), "names")
    each = each.join(found, "model").join(patched.select(F.col("__o"), F.lit(True).alias("own")), F.col("model") == F.col("__o"), "left")
    own = F.coalesce("own", F.lit(False))
    each = each.where(F.when(F.col("kind") == 0, own).when(F.col("kind") == 1, F.col("direct")).otherwise(F.lit(True)))
    each = each.groupBy("list", "model").agg(F.min("pos").alias("pos"), F.first("tab").alias("tab"), F.first("name").alias("name"), F.first("how").alias("how"), F.first(own).alias("own"))

    models = found.select("model", user_alias(F.col("model"), of.user_aliases).alias("other"))
    base = without_date(F.col("model"))
    split = of.rows.where(F.col("tab") == CATALOGUE)
    split = models.select("model", F.explode(F.array_compact(F.array(F.struct(F.lit(0).alias("o"), _alias(base, of.aliases).alias("n")), F.struct(F.lit(1).alias("o"), base.alias("n"))))).alias("x")).join(
        split.select(F.col("name").alias("__n"), F.col("threshold").alias("t")), F.col("x.n") == F.col("__n")
    ).groupBy("model").agg(F.min_by("t", "x.o").alias("split"))
    keys = models.select("model", "other", F.explode(F.array_compact(F.array("model", "other"))).alias("n"))
    due = keys.join(of.schedule, pricing_key(F.col("n")) == pricing_key(F.col("s_model")))
    at = F.when(F.col("n") == F.col("s_model"), 0).otherwise(1) + F.when(F.col("n") == F.col("model"), 0).otherwise(2)
    first = due.groupBy("model").agg(F.min_by("s_model", at).alias("scheduled"))
    eras = due.join(first, "model").where("s_model = scheduled").groupBy("model", "other", "scheduled").agg(F.collect_set(F.struct("from_ms", "to_ms", *_ERA)).alias("eras"))
    names = eras.select("model", "eras", F.posexplode(F.array("model", "other", "scheduled")).alias("o", "n"))
    patches = names.join(patched, F.col("n") == F.col("__o"), "left").groupBy("model").agg(F.first("eras").alias("eras"), F.min_by("patch", F.when(F.col("patch").isNotNull(), F.col("o"))).alias("patch"))

    rates = of.rows.select("tab", "name", *_RATES, "read_explicit", "threshold", "fast_multiplier")
    each = each.join(rates, ["tab", "name"], "left").join(split, "model", "left").join(patches, "model", "left")
    near = F.col("how") == "fuzzy"
    rank = F.when(near, 0).when(F.col("own"), 0).when(F.contains("model", F.lit("/")), 1).otherwise(2)
    zero = lambda c: F.when(F.col("how") == "free", F.lit(0).cast("long")).otherwise(F.col(c)).alias(c)
    price = F.struct(
        near.alias("near"), rank.alias("rank"), "pos", "model", "name", *[zero(f"{k}_rate") for k in KINDS], *[f"{k}_above" for k in KINDS], "read_explicit", "threshold", "fast_multiplier", "split",
        "eras", *[F.col(f"patch.{p}").alias(f"patch_{p}") for p in PATCHES],
    )
    ordered = each.groupBy("list").agg(F.array_sort(F.collect_list(price)).alias("prices"))  # a few names a list
    return ordered.select("list", F.filter("prices", lambda p: p["near"] == F.get("prices", 0)["near"]).alias("prices"))


def _in_force(p: Column, ts: Column, timeless: Column) -> Column:
    """A price with the rates of its era and time of day, if it has a schedule and the row a time that counts; then overrides once more."""
    era = F.get(F.filter(p["eras"], lambda e: (ts >= e["from_ms"]) & (ts < e["to_ms"])), 0)
    return F.struct(p.alias("p"), F.when(~timeless & p["eras"].isNotNull(), era).alias("era"))


def _effective(x: Column, peak: Column) -> Column:
    p, era = x["p"], x["era"]
    now = lambda k: F.when(peak, era[f"{k}_peak"]).otherwise(era[f"{k}_off"])
    pick = lambda k, s: F.when(era.isNotNull(), F.coalesce(p[f"patch_{k}" if s == "rate" else f"patch_{k}_above"], now(k))).otherwise(p[f"{k}_{s}"]).alias(f"{k}_{s}")
    fast = F.when(era.isNotNull(), F.coalesce(p["patch_fast_multiplier"], p["fast_multiplier"])).otherwise(p["fast_multiplier"])
    return F.struct(*[pick(k, s) for s in ("rate", "above") for k in KINDS], F.coalesce(era.isNotNull() | p["read_explicit"], F.lit(True)).alias("read_explicit"), p["threshold"].alias("threshold"),
                    F.coalesce(p["split"], F.lit(LONG_CONTEXT)).alias("split"), F.coalesce(fast, F.lit(1.0)).alias("fast"))


def _cost(r: Column, counts: dict[str, Column], hour: Column, fast: Column, codex: Column, asked: Column) -> Column:
    """Picodollars of a row at rates `r`: by bucket, by request beyond a threshold of the price, or by the rule of codex."""
    def tiered(n: Column, base: Column, above: Column) -> Column:
        return F.when(above.isNotNull() & (n > LONG_CONTEXT), LONG_CONTEXT * base + (n - LONG_CONTEXT) * above).otherwise(n * base)

    def whole(long: Column, read: bool = False) -> Column:
        rate = lambda k: F.when(long, F.coalesce(r[f"{k}_above"], r[f"{k}_rate"])).otherwise(r[f"{k}_rate"])
        reads = F.when(r["read_explicit"], rate("read")).otherwise(rate("input")) if read else rate("read")
        created = counts["create"] * rate("create") if read else (counts["create"] - hour) * rate("create") + hour * rate("input") * 2
        return counts["input"] * rate("input") + counts["output"] * rate("output") + created + counts["read"] * reads

    short = {**counts, "create": counts["create"] - hour}
    plain = reduce(lambda a, b: a + b, [tiered(short[k], r[f"{k}_rate"], r[f"{k}_above"]) for k in KINDS]) + tiered(hour, r["input_rate"] * 2, r["input_above"] * 2)
    by_request = whole(counts["input"] + counts["read"] + counts["create"] > r["threshold"])
    cost = F.when(codex, whole(asked > r["split"], True)).when(r["threshold"].isNotNull(), by_request).otherwise(plain)
    return F.when(fast, F.floor(cost * r["fast"] + 0.5).cast("long")).otherwise(cost)


def price(usage: DataFrame, of: Book, mode: str = "auto", broadcast_lists: int = BROADCAST_LISTS) -> DataFrame:
    """usage with cost_pico and missing_pricing.

    mode: `display` takes the recorded cost_usd or 0, `auto` the recorded one if there is one, `calculate` always computes. Of a
    row's prices the first that costs something counts, else the first; with `first_found` the first in any case. Optional
    columns, null as absent: candidates, exact_candidates, override_candidates; one_hour (cache writes for an hour);
    create_as_input and extra_as_output (counters billed as others); ignores_time (no schedule); recorded_zero (free by
    record, so nothing is missing); first_found. Rows of the agent codex are priced by the whole request's input.

    No names: cost 0, nothing missing. Names without a price: cost 0, and missing if the row has a model and tokens.
    usage is read twice: for its distinct lists of names, whose prices are written once, and for the join with them, which is
    a broadcast up to `broadcast_lists` lists and a shuffle on the list's hash beyond.
    """
    spark = usage.sparkSession
    zero = F.lit(0).cast("long")
    recorded = F.floor(F.col("cost_usd") * F.lit(1e12) + 0.5).cast("long")
    if mode == "display":
        return usage.select("*", F.coalesce(recorded, zero).alias("cost_pico"), F.lit(False).alias("missing_pricing"))
    lists = usage.select(name_lists(usage).alias("list")).distinct()
    prices, _ = written(price_lists(lists, of).withColumn("__h", F.xxhash64("list")), "prices")
    small = prices.count() <= broadcast_lists
    work = usage.withColumn("__list", name_lists(usage)).withColumn("__k", F.xxhash64("__list"))
    work = work.join(F.broadcast(prices) if small else prices, (F.col("__k") == F.col("__h")) & (F.col("__list") == F.col("list")), "left")

    counts = {k: F.coalesce(F.col(c), zero) for k, c in _TOKENS.items()}
    extra = _have(usage, "extra_tokens", "long", 0)
    asked = counts["input"] + counts["read"] + counts["create"]
    counts["output"] = counts["output"] + F.when(_have(usage, "extra_as_output", "boolean", False), extra).otherwise(zero)
    as_input = _have(usage, "create_as_input", "boolean", False)
    counts["input"], counts["create"] = counts["input"] + F.when(as_input, counts["create"]).otherwise(zero), F.when(as_input, zero).otherwise(counts["create"])
    codex = F.coalesce(F.col("agent") == "codex", F.lit(False)) if "agent" in usage.columns else F.lit(False)
    timeless = _have(usage, "ignores_time", "boolean", False) | F.col("ts_ms").isNull()
    inputs = F.struct(*[c.alias(f"n_{k}") for k, c in counts.items()], _have(usage, "one_hour", "long", 0).alias("hour"), _have(usage, "fast", "boolean", False).alias("fast"), codex.alias("codex"), asked.alias("asked"), is_peak(F.col("ts_ms")).alias("peak"))
    work = work.withColumn("__in", inputs)
    i = F.col("__in")
    of_row = {k: i[f"n_{k}"] for k in KINDS}
    work = work.withColumn("__eff", F.transform(F.transform("prices", lambda p: _in_force(p, F.col("ts_ms"), timeless)), lambda x: _effective(x, i["peak"])))
    work = work.withColumn("__costs", F.transform("__eff", lambda r: _cost(r, of_row, i["hour"], i["fast"], i["codex"], i["asked"])))
    first = F.get("__costs", 0)
    best = F.coalesce(F.get(F.filter("__costs", lambda c: c > 0), 0), first)
    computed = F.coalesce(F.when(_have(usage, "first_found", "boolean", False), first).otherwise(best), zero)
    tokens = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), zero) for c in _TOKENS.values()]) + extra
    missing = F.col("prices").isNull() & F.col("model").isNotNull() & (tokens > 0) & ~_have(usage, "recorded_zero", "boolean", False)
    if mode == "auto":
        computed, missing = F.coalesce(recorded, computed), missing & F.col("cost_usd").isNull()
    return work.select(*[F.col(f"`{c}`") for c in usage.columns], computed.alias("cost_pico"), missing.alias("missing_pricing"))
