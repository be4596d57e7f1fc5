"""Model-name resolution against price lists: exact, by identity, free tiers, consensus, then fuzzy containment.

Equal and identity matches, free tiers and consensus are joins and aggregations over names. Only names that none of
them resolves are compared with every listed name by expressions, one row a distinct unresolved name: usage rows
never meet the list more than once, and the list is a short dimension.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_free, model_identity, pricing_key
from .pricing import ALIASES, KINDS, consensus

_QUOTE = r"([\\.\[\]{}()*+?^$|])"
#: Fixed value: what may follow a name and still name the same model: a date and a version.
_TRAILER = r"(-\d{8}|-\d{4}-\d{2}-\d{2})?(-v\d+(:\d+)?)?$"


def contains_name(value: Column, key: Column) -> Column:
    """Whether key stands in value between characters that aren't letters or digits.

    After a key that ends in a digit no further version number may follow, unless it is a date of eight digits.
    """
    quoted = F.regexp_replace(key, _QUOTE, r"\\$1")
    plain = F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
    numbered = F.concat(plain, F.lit(r"(?![-.](?!\d{8}(?![A-Za-z0-9]))\d)"))
    return (F.length(key) > 0) & F.when(key.rlike("[0-9]$"), F.regexp_like(value, numbered)).otherwise(F.regexp_like(value, plain))


def _same_model(key: Column, model: Column) -> Column:
    """Whether key is the model with something before it and at most a date and a version after."""
    quoted = F.regexp_replace(model, _QUOTE, r"\\$1")
    return F.regexp_like(key, F.concat(F.lit("(?<![A-Za-z0-9])"), quoted, F.lit(_TRAILER)))


def fuzzy_rank(key: Column, model: Column) -> Column:
    """2: the key stands in the model, or names the same model; 1: the model stands in the key; 0: neither."""
    k, m = pricing_key(key), pricing_key(model)
    two = contains_name(model, key) | contains_name(m, k) | _same_model(key, model) | _same_model(k, m)
    return F.when(two, 2).when(contains_name(key, model) | contains_name(k, m), 1).otherwise(0)


def resolve(models: DataFrame, rates: DataFrame, aliases: dict[str, str] | None = None, fuzzy: bool = True) -> DataFrame:
    """(model, price_model, how) for each distinct name in `model`; price_model null where nothing fits.

    how: exact, identity (case and `.`, `@`, `-` aside; the first name in order), free (price_model null, no
    cost), consensus (the rates that most providers list), fuzzy (rank 2: the longest name, rank 1: the
    shortest, ties in order), or null.
    """
    names = dict(ALIASES if aliases is None else aliases)
    alias = F.coalesce(*[F.when(F.col("model") == a, F.lit(b)) for a, b in sorted(names.items())]) if names else F.lit(None).cast("string")
    m = models.select("model").where("model is not null").distinct().withColumn("alias", alias)
    r = rates.select("price_model")
    ident = r.groupBy(model_identity(F.col("price_model")).alias("identity")).agg(F.min("price_model").alias("by_identity"))
    agreed = consensus(rates).select("tail", F.col("price_model").alias("by_consensus"))
    m = m.join(F.broadcast(r.select(F.col("price_model").alias("exact_1"))), F.col("model") == F.col("exact_1"), "left")
    m = m.join(F.broadcast(r.select(F.col("price_model").alias("exact_2"))), F.col("alias") == F.col("exact_2"), "left")
    m = m.join(F.broadcast(ident), model_identity(F.coalesce("alias", "model")) == F.col("identity"), "left")
    m = m.join(F.broadcast(agreed), F.regexp_extract(F.coalesce("alias", "model"), r"[^/]*$", 0) == F.col("tail"), "left")
    exact = F.coalesce("exact_1", "exact_2")
    how = F.when(exact.isNotNull(), "exact").when(F.col("by_identity").isNotNull(), "identity").when(is_free(F.col("model")), "free").when(F.col("by_consensus").isNotNull(), "consensus")
    found = F.when(exact.isNotNull(), exact).when(F.col("by_identity").isNotNull(), F.col("by_identity")).when(is_free(F.col("model")), F.lit(None)).otherwise(F.col("by_consensus"))
    known = m.select("model", "alias", found.alias("price_model"), how.alias("how"))
    if not fuzzy:
        return known.drop("alias")
    # One row a distinct unresolved name meets the short list; usage rows don't.
    open_ = known.where("how is null").select("model", F.coalesce("alias", "model").alias("name"))
    listed = F.broadcast(r.agg(F.array_sort(F.collect_set("price_model")).alias("listed")))
    near = open_.join(listed, F.lit(True)).select("model", "name", F.explode("listed").alias("key"))
    near = near.withColumn("rank", fuzzy_rank(F.col("key"), F.col("name"))).where("rank > 0")
    size = F.when(F.col("rank") == 2, -F.length("key")).otherwise(F.length("key"))
    best = near.groupBy("model").agg(F.min(F.struct((-F.col("rank")).alias("r"), size.alias("l"), "key")).alias("b")).select("model", F.col("b.key").alias("by_fuzzy"))
    out = known.join(best, "model", "left")
    return out.select("model", F.coalesce("price_model", "by_fuzzy").alias("price_model"), F.when(F.col("by_fuzzy").isNotNull() & F.col("how").isNull(), "fuzzy").otherwise(F.col("how")).alias("how"))


def price_usage(usage: DataFrame, rates: DataFrame, aliases: dict[str, str] | None = None, overrides: list[str] | None = None) -> DataFrame:
    """usage with `priced_as`, the listed name that prices a row, and `price_found`, whether any of its names has a price.

    A row's names are its `candidates`, or its model where it has none. Names that are found without a fuzzy match go
    first: overridden ones, then those with a provider, then bare ones, each in their order. Only if there are none, fuzzy
    matches count, in their order. Of these names the first that costs something for the row's tokens prices it, else the
    first. Each distinct list of names is resolved once; usage rows meet the result in one join on that list.
    """
    have = F.array_compact("candidates") if "candidates" in usage.columns else F.array().cast("array<string>")
    names = F.when(F.size(have) > 0, have).when(F.col("model").isNotNull(), F.array("model"))
    work = usage.withColumn("__names", names)
    lists = work.select("__names").where("__names is not null").distinct()
    each = lists.select("__names", F.posexplode("__names").alias("pos", "model"))
    rank = F.when(F.col("model").isin(overrides or []), 0).when(F.contains("model", F.lit("/")), 1).otherwise(2)
    found = each.join(resolve(each, rates, aliases), "model").where("how is not null")
    found = found.join(rates.select("price_model", *[f"{k}_rate" for k in KINDS]), "price_model", "left")
    near = (F.col("how") == "fuzzy").alias("near")
    entry = F.struct(near, F.when(F.col("how") == "fuzzy", 0).otherwise(rank).alias("rank"), "pos", "price_model", *[f"{k}_rate" for k in KINDS])
    ordered = found.groupBy("__names").agg(F.array_sort(F.collect_list(entry)).alias("prices"))  # a few names a list
    ordered = ordered.select(F.col("__names").alias("__list"), F.filter("prices", lambda p: p["near"] == F.get("prices", 0)["near"]).alias("prices"))
    tokens = dict(zip(KINDS, ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"], strict=True))
    costs = lambda p: reduce(lambda a, b: a | b, [(F.col(t) > 0) & F.coalesce(p[f"{k}_rate"] > 0, F.lit(False)) for k, t in tokens.items()])
    best = F.coalesce(F.get(F.filter("prices", costs), 0), F.get("prices", 0))
    out = work.join(ordered, F.col("__names") == F.col("__list"), "left")
    return out.select(*usage.columns, best["price_model"].alias("priced_as"), F.col("prices").isNotNull().alias("price_found"))
