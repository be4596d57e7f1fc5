"""Price lists in layers: kept apart with their provenance, merged by rule, and names resolved through them in order.

The primary table grows from layers in their order: a layer replaces rows, fills in names that aren't listed, completes
rates that a row left to be derived, or patches single rates. The catalogue is a second table, asked after the primary
one, with names that only their own spelling finds. Both are rows of one DataFrame, told apart by `tab`; lists may be
long, and nothing of them passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_free, model_identity, pricing_key, without_date
from ..scratch import written
from . import pricing
from .pricing import ALIASES, KINDS, pico
from .resolve import fuzzy_rank

PRIMARY, CATALOGUE = 0, 1
PRICE = T.StructType([
    T.StructField("name", T.StringType()), *[T.StructField(f"{k}_rate", T.LongType()) for k in KINDS], *[T.StructField(f"{k}_above", T.LongType()) for k in KINDS],
    T.StructField("create_explicit", T.BooleanType()), T.StructField("read_explicit", T.BooleanType()), T.StructField("threshold", T.LongType()),
    T.StructField("fast_multiplier", T.DoubleType()), T.StructField("exact_only", T.BooleanType()), T.StructField("context", T.LongType()),
])
_FIELDS = [f.name for f in PRICE.fields]
#: Of the rates that come with the library: names that replace a listed price, and those that only complete one.
OVERWRITE = ("gpt-5.1-codex", "gpt-5.2-codex", "gpt-5.2")
COMPLETE = ("glm-4.5", "glm-4.6", "glm-4.7", "zai/glm-4.5", "zai/glm-4.5-x", "zai/glm-4.5-air", "zai/glm-4.5-airx", "zai/glm-4.5v", "zai/glm-4-32b-0414-128k", "zai/glm-4.5-flash")
#: Fields of an override: rates in dollars per million tokens by kind, `<kind>_above`, and the fast tier's multiple.
PATCHES = [*KINDS, *[f"{k}_above" for k in KINDS], "fast_multiplier"]


def _pico(dollars: Column, per: int) -> Column:
    """Picodollars a token from dollars for so many tokens."""
    return F.round(dollars * F.lit(1e12 / per)).cast("long")


def fast_multiple(name: Column) -> Column:
    """pricing.fast_multiplier() as an expression: by the name, what it stands for, or a part of its path; null if there is none."""
    known = {**{a: pricing.FAST_EXACT[b] for a, b in ALIASES.items() if b in pricing.FAST_EXACT}, **pricing.FAST_EXACT}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def of(part: Column) -> Column:
        plain = pricing_key(part)
        after = lambda base: F.regexp_extract(plain, f"^.*{base}(.*)$", 1)
        by_base = [F.when(F.contains(plain, F.lit(b)) & ((after(b) == "") | after(b).startswith("-")), F.lit(m)) for b, m in pricing.FAST_PREFIX.items()]
        return F.coalesce(F.try_element_at(table, part), *by_base)

    return F.get(F.array_compact(F.transform(F.concat(F.array(name), F.split(name, "[/:]")), of)), 0)


def _fast(rows: DataFrame, given: Column) -> DataFrame:
    """rows with the multiple of the fast tier: as given, else by name."""
    return rows.withColumn("fast_multiplier", F.coalesce(given, fast_multiple(F.col("name")), F.lit(1.0)))


def compact_list(spark: SparkSession, path: str) -> DataFrame:
    """PRICE rows of a JSON file {name: {i, o, cc, cr, ia, oa, cca, cra, ctx, fast}} in dollars a token; a write or read rate that isn't given is derived from input."""
    one = "struct<i: double, o: double, cc: double, cr: double, ia: double, oa: double, cca: double, cra: double, ctx: double, fast: double>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {one}>")).alias("name", "p"))
    rows = rows.where("p.i is not null and p.o is not null")
    p = F.col("p")
    rate = lambda x: _pico(x, 1)
    out = rows.select(
        "name", rate(p["i"]).alias("input_rate"), rate(p["o"]).alias("output_rate"), rate(F.coalesce(p["cc"], p["i"] * 1.25)).alias("create_rate"), rate(F.coalesce(p["cr"], p["i"] * 0.1)).alias("read_rate"),
        rate(p["ia"]).alias("input_above"), rate(p["oa"]).alias("output_above"), rate(p["cca"]).alias("create_above"), rate(p["cra"]).alias("read_above"), p["cc"].isNotNull().alias("create_explicit"),
        p["cr"].isNotNull().alias("read_explicit"), F.lit(None).cast("long").alias("threshold"), F.lit(False).alias("exact_only"), F.nullif(p["ctx"].cast("long"), F.lit(0)).alias("context"), p["fast"].alias("__fast"),
    )
    return _fast(out, F.col("__fast")).select(*_FIELDS)


def catalogue_list(spark: SparkSession, path: str) -> DataFrame:
    """PRICE rows of a JSON file {name: {cost: {input, output, cache_read, cache_write, tiers}, exactOnly, limit}} in dollars per million tokens.

    Names without any cost are left out. Of the tiers by context the one with the least size gives the rates above it.
    """
    rates = "input: double, output: double, cache_read: double, cache_write: double"
    one = f"struct<cost: struct<{rates}, tiers: array<struct<{rates}, tier: struct<type: string, size: double>>>>, exactOnly: boolean, limit: struct<context: double>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {one}>")).alias("name", "p"))
    c = F.col("p.cost")
    rows = rows.where(~((c["input"] == 0) & (c["output"] == 0)) & c["input"].isNotNull() & c["output"].isNotNull())
    sized = F.filter(c["tiers"], lambda t: (t["tier"]["type"] == "context") & (t["tier"]["size"] > 0))
    least = F.get(F.array_sort(sized, lambda a, b: F.when(a["tier"]["size"] < b["tier"]["size"], -1).when(a["tier"]["size"] > b["tier"]["size"], 1).otherwise(0)), 0)
    rate = lambda x: _pico(x, 1_000_000)
    out = rows.withColumn("t", least)
    t = F.col("t")
    out = out.select(
        "name", rate(c["input"]).alias("input_rate"), rate(c["output"]).alias("output_rate"), rate(F.coalesce(c["cache_write"], c["input"] * 1.25)).alias("create_rate"),
        rate(F.coalesce(c["cache_read"], c["input"] * 0.1)).alias("read_rate"), rate(t["input"]).alias("input_above"), rate(t["output"]).alias("output_above"), rate(t["cache_write"]).alias("create_above"),
        rate(t["cache_read"]).alias("read_above"), c["cache_write"].isNotNull().alias("create_explicit"), c["cache_read"].isNotNull().alias("read_explicit"), t["tier"]["size"].cast("long").alias("threshold"),
        F.coalesce("p.exactOnly", F.lit(False)).alias("exact_only"), F.nullif(F.col("p.limit.context").cast("long"), F.lit(0)).alias("context"),
    )
    return _fast(out, F.lit(None).cast("double")).select(*_FIELDS)


def given_rows(spark: SparkSession, rates: dict[str, tuple], above: dict[str, tuple] | None = None) -> DataFrame:
    """PRICE rows of rates (input, output, write, read) in dollars per million tokens, all of them explicit."""
    rows = [
        (m, *map(pico, r), *map(pico, (above or {}).get(m, (None,) * 4)), True, True, None, pricing.fast_multiplier(m), False, None) for m, r in rates.items()
    ]
    return spark.createDataFrame(rows, PRICE)


def flat_rows(rates: DataFrame) -> DataFrame:
    """PRICE rows of a flat rate table (pricing.RATE_DDL)."""
    return rates.select(F.col("price_model").alias("name"), *[f"{k}_rate" for k in KINDS], *[f"{k}_above" for k in KINDS], F.lit(True).alias("create_explicit"), "read_explicit", "threshold",
                        "fast_multiplier", F.lit(False).alias("exact_only"), F.lit(None).cast("long").alias("context"))


def override_rows(spark: SparkSession, overrides: dict[str, dict]) -> DataFrame:
    """(name, patch): the user's overrides, fields that aren't given null."""
    ddl = "name string, patch struct<" + ", ".join(f"{p}: {'double' if p == 'fast_multiplier' else 'long'}" for p in PATCHES) + ">"
    rows = [(m, tuple(o.get(p) if p == "fast_multiplier" else pico(o.get(p)) for p in PATCHES)) for m, o in overrides.items()]
    return spark.createDataFrame(rows, ddl)


def merged(layers: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """PRICE rows and `provenance` of one table from its layers (name of the layer, rule, PRICE rows), in their order.

    Rules: `replace` takes the layer's row; `fill` takes it for names that aren't listed yet; `complete` does, and gives a
    listed row the write and read rates that it only derives. A name twice in a layer: the greater row counts last.
    One aggregation by name; a name has a row a layer.
    """
    rows = reduce(DataFrame.unionByName, [df.select(*_FIELDS).withColumns({"__at": F.lit(i), "__rule": F.lit(rule), "provenance": F.lit(layer)}) for i, (layer, rule, df) in enumerate(layers)])
    inner = [f for f in _FIELDS if f != "name"]
    own = F.struct("__at", *inner, "provenance", "__rule")
    lists = rows.groupBy("name").agg(F.array_sort(F.collect_list(own)).alias("rows"))
    row = lambda x: F.struct(*[x[f].alias(f) for f in inner], x["provenance"].alias("provenance"))
    empty = F.lit(None).cast(T.StructType([*[f for f in PRICE.fields if f.name != "name"], T.StructField("provenance", T.StringType())]))

    def step(acc: Column, x: Column) -> Column:
        def completed(f: str) -> Column:
            if f in ("create_explicit", "read_explicit"):
                return F.lit(True).alias(f)
            if f in ("create_rate", "read_rate"):
                return F.when(acc[f.replace("rate", "explicit")], acc[f]).otherwise(x[f]).alias(f)
            return acc[f].alias(f)

        both = F.struct(*[completed(f) for f in inner], F.concat_ws("+", acc["provenance"], x["provenance"]).alias("provenance"))
        return F.when(acc.isNull() | (x["__rule"] == "replace"), row(x)).when(x["__rule"] == "fill", acc).otherwise(both)

    return lists.select("name", F.reduce("rows", empty, step).alias("r")).select("name", "r.*")


def with_long_context(primary: DataFrame, catalogue: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """primary rows without any rate for long requests take those, and their threshold, from the catalogue: by the name without a date, or what it stands for."""
    base = without_date(F.col("name"))
    source = lambda n: catalogue.select(F.col("name").alias(f"__n{n}"), F.struct(*[f"{k}_above" for k in KINDS], "threshold").alias(f"__s{n}"))
    work = primary.withColumns({"__base": base, "__alias": _alias(base, aliases)})
    work = work.join(source(1), F.col("__alias") == F.col("__n1"), "left").join(source(2), F.col("__base") == F.col("__n2"), "left")
    s = F.coalesce("__s1", "__s2")
    none = reduce(lambda a, b: a & b, [F.col(f"{k}_above").isNull() for k in KINDS]) & s["threshold"].isNotNull()
    new = {f: F.when(none, s[f]).otherwise(F.col(f)) for f in [*[f"{k}_above" for k in KINDS], "threshold"]}
    new["provenance"] = F.when(none, F.concat("provenance", F.lit("+catalogue"))).otherwise(F.col("provenance"))
    return work.withColumns(new).select(*primary.columns)


def overridden(primary: DataFrame, overrides: DataFrame) -> DataFrame:
    """primary with the user's overrides: single rates of listed names, and names of their own if they have input and output."""
    work = primary.join(overrides, "name", "full")
    p, new = F.col("patch"), F.col("provenance").isNull()
    own = {"create_rate": F.round(p["input"] * 1.25).cast("long"), "read_rate": F.round(p["input"] * 0.1).cast("long"), "create_explicit": F.lit(False), "read_explicit": F.lit(False),
           "fast_multiplier": F.lit(1.0), "exact_only": F.lit(False)}
    cols = {}
    for f in _FIELDS[1:]:
        kind = f.replace("_rate", "").replace("_explicit", "") if f.endswith(("_rate", "_explicit")) else f
        base = F.when(new, own[f]).otherwise(F.col(f)) if f in own else F.col(f)
        cols[f] = base | F.coalesce(p[kind].isNotNull(), F.lit(False)) if f.endswith("_explicit") else F.coalesce(p[kind], base) if kind in PATCHES else base
    cols["provenance"] = F.when(p.isNull(), F.col("provenance")).otherwise(F.concat_ws("+", "provenance", F.lit("override")))
    return work.withColumns(cols).where("input_rate is not null and output_rate is not null").select("name", *_FIELDS[1:], "provenance")


@dataclass
class Book:
    """The tables (PRICE, tab, provenance), the user's overrides (name, patch), and the schedule of eras."""

    rows: DataFrame
    overrides: DataFrame
    schedule: DataFrame
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))
    user_aliases: dict[str, str] = field(default_factory=dict)


def book(
    spark: SparkSession, snapshot: DataFrame | None = None, catalogue: DataFrame | None = None, live: DataFrame | None = None, overrides: dict[str, dict] | None = None,
    builtin: bool = True, schedule: list | None = None, user_aliases: dict[str, str] | None = None,
) -> Book:
    """The book of a snapshot list, the library's own rates, a live list and the user's overrides, with a catalogue behind.

    Order of the layers: snapshot; own rates that fill, replace or complete; live list; long-request rates of the
    catalogue where a name has none; overrides. Last, scheduled models that nothing lists get the rates of their first era.
    """
    empty = spark.createDataFrame([], PRICE)
    catalogue = (empty if catalogue is None else catalogue).select(*_FIELDS)
    layers = [] if snapshot is None else [("snapshot", "replace", snapshot)]
    if builtin:
        of = lambda names, keep: {m: r for m, r in pricing.RATES.items() if (m in names) == keep}
        layers += [("builtin", "fill", given_rows(spark, of(OVERWRITE + COMPLETE, False), pricing.ABOVE)), ("builtin", "replace", given_rows(spark, of(OVERWRITE, True))),
                   ("builtin", "complete", given_rows(spark, of(COMPLETE, True)))]
    if live is not None:
        layers.append(("live", "replace", live))
    eras = pricing.SCHEDULE if schedule is None else schedule
    first: dict[str, tuple] = {}
    for m, _, off, _ in eras:
        first.setdefault(m, off)
    layers.append(("schedule", "fill", given_rows(spark, first)))
    patches = override_rows(spark, overrides or {})
    primary = overridden(with_long_context(merged(layers), catalogue), patches)
    second = catalogue.withColumn("provenance", F.lit("catalogue"))
    rows = primary.withColumn("tab", F.lit(PRIMARY)).unionByName(second.withColumn("tab", F.lit(CATALOGUE)))
    rows, _ = written(rows, "book")  # read several times for each resolution
    return Book(rows, patches, pricing.schedule_table(spark, eras), user_aliases=dict(user_aliases or {}))


def flat_book(rates: DataFrame, overrides: dict[str, dict] | None = None, user_aliases: dict[str, str] | None = None) -> Book:
    """A book of one flat rate table, patched by the overrides."""
    spark = rates.sparkSession
    patches = override_rows(spark, overrides or {})
    rows = flat_rows(rates).withColumn("provenance", F.lit("list"))
    rows = (overridden(rows, patches) if overrides else rows).withColumn("tab", F.lit(PRIMARY))
    rows, _ = written(rows, "book")
    return Book(rows, patches, pricing.schedule_table(spark), user_aliases=dict(user_aliases or {}))


def _alias(name: Column, aliases: dict[str, str]) -> Column:
    """What a name stands for; null if nothing."""
    return F.coalesce(*[F.when(name == a, F.lit(b)) for a, b in sorted(aliases.items())]) if aliases else F.lit(None).cast("string")


def user_alias(name: Column, aliases: dict[str, str]) -> Column:
    """The user's other name for a model; one that ends in -fast keeps the ending. Null if there is none."""
    stem = F.regexp_replace(name, "-fast$", "")
    return F.coalesce(_alias(name, aliases), F.when(name.endswith("-fast"), F.concat(_alias(stem, aliases), F.lit("-fast"))))


#: Steps between the levels of a look-up: kind of match, then table, then which of the two names.
_EXACT, _IDENTITY, _FREE, _CONSENSUS, _FUZZY = 0, 1000, 2000, 3000, 4000


def resolve_names(models: DataFrame, of: Book, fuzzy: bool = True) -> DataFrame:
    """(model, tab, name, how, direct) of each distinct name in `model` that some rule resolves; name and tab are null where it is free.

    Levels in their order, each for the name and then the user's other name for it: listed in the primary table (itself,
    what it stands for, or by the spelling of an exact-only name), the same in the catalogue, identity (case and `.`, `@`,
    `-` aside) in the primary table and in the catalogue, free tier, the rates that most providers list in both tables,
    then fuzzy containment in the primary table and in the catalogue. Fuzzy matches leave out exact-only names, and names
    spelled like one. `direct`: listed under this very name or spelling.

    Names meet the lists by keys only: names, spellings, identities and tails in one join, and fuzzy matches by a token
    that both must hold, so no name is compared with the whole list.
    """
    other = user_alias(F.col("model"), of.user_aliases)
    m = models.select("model").where("model is not null").distinct().withColumn("names", F.array_distinct(F.array_compact(F.array(F.col("model"), other))))
    each = m.select("model", F.posexplode("names").alias("k", "n")).withColumn("a", _alias(F.col("n"), of.aliases))
    stands = F.coalesce("a", "n")
    key = lambda kind, k, step, near=0: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(step).alias("step"), F.lit(near).alias("sub"))
    looks = F.array(
        key("name", F.col("n"), _EXACT, 0), key("name", F.col("a"), _EXACT, 1), key("spelled", pricing_key(F.col("a")), _EXACT, 2), key("spelled", pricing_key(F.col("n")), _EXACT, 3),
        key("identity", model_identity(stands), _IDENTITY), key("tail", model_identity(F.regexp_extract(stands, "[^/]*$", 0)), _CONSENSUS),
    )
    looked = each.select("model", "k", F.explode(looks).alias("l")).select("model", "k", "l.*").where("key <> ''")

    rows = of.rows.select("tab", "name", "exact_only", "input_rate", "output_rate", "read_rate")
    index = rows.select(F.lit("name").alias("kind"), F.col("name").alias("key"), "tab", "name")
    index = index.union(rows.where("exact_only").groupBy("tab", pricing_key(F.col("name")).alias("key")).agg(F.max("name").alias("name")).select(F.lit("spelled"), "key", "tab", "name"))
    index = index.union(rows.groupBy("tab", model_identity(F.col("name")).alias("key")).agg(F.min("name").alias("name")).select(F.lit("identity"), "key", "tab", "name"))
    tails = rows.where(F.contains("name", F.lit("/"))).withColumn("key", model_identity(F.regexp_extract("name", "[^/]*$", 0)))
    order = F.struct(F.length("name").alias("l"), "tab", "name")
    agreed = tails.groupBy("key", "input_rate", "output_rate", "read_rate").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    agreed = agreed.groupBy("key").agg(F.min_by("o", F.struct((-F.col("n")).alias("n"), "o")).alias("o"))
    index = index.union(agreed.select(F.lit("tail"), "key", "o.tab", "o.name"))

    hits = looked.join(index, ["kind", "key"])
    by_table = F.when(F.col("step") == _CONSENSUS, 0).otherwise(F.col("tab") * 100)
    level = F.col("step") + by_table + F.col("k") * 10 + F.col("sub")
    hits = hits.select("model", level.alias("level"), "tab", "name", ((F.col("k") == 0) & (F.col("step") == _EXACT) & F.col("sub").isin(0, 3)).alias("direct"))
    free = m.where(is_free(F.col("model"))).select("model", F.lit(_FREE).alias("level"), F.lit(None).cast("int").alias("tab"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("direct"))
    best = hits.unionByName(free).groupBy("model").agg(F.min(F.struct("level", "tab", "name")).alias("b"), F.max("direct").alias("direct"))
    if fuzzy:
        left = each.join(best, "model", "left_anti")
        best = best.unionByName(_fuzzy(left, looked, rows))
    how = F.when(F.col("b.level") < _IDENTITY, "exact").when(F.col("b.level") < _FREE, "identity").when(F.col("b.level") < _CONSENSUS, "free").when(F.col("b.level") < _FUZZY, "consensus").otherwise("fuzzy")
    return best.select("model", "b.tab", "b.name", how.alias("how"), "direct")


def _tokens(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda t: t != ""))


def _longest(tokens: Column) -> Column:
    """The longest token, which is the rarest as a rule; of equal ones the first."""
    return F.reduce(tokens, F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))


def _fuzzy(left: DataFrame, looked: DataFrame, rows: DataFrame) -> DataFrame:
    """(model, b, direct) of names that nothing else resolves: the best containment in the first table that has one.

    Of two names of which one stands in the other between boundaries, every token of the shorter is a token of the
    longer; so they meet on the longest token of either.
    """
    spelled = looked.where("kind = 'spelled'").select("model", "key").join(rows.where("exact_only").select(pricing_key(F.col("name")).alias("key")).distinct(), "key").select("model").distinct()
    tries = left.join(spelled, "model", "left_anti").select("model", F.explode(F.array_compact(F.array(F.struct("k", F.lit(0).alias("s"), F.col("a").alias("n")), F.struct("k", F.lit(1).alias("s"), "n")))).alias("t"))
    tries = tries.select("model", "t.*").where("n is not null and n <> ''").withColumn("tokens", _tokens(F.col("n")))
    listed = rows.where(~F.col("exact_only")).select("tab", "name").withColumn("tokens", _tokens(F.col("name")))
    one = lambda df: df.withColumn("token", _longest(F.col("tokens"))).drop("tokens")
    every = lambda df: df.withColumn("token", F.explode("tokens")).drop("tokens")
    near = every(tries).join(one(listed), "token").union(one(tries).join(every(listed), "token")).drop("token").distinct()
    near = near.withColumn("rank", fuzzy_rank(F.col("name"), F.col("n"))).where("rank > 0")
    size = F.when(F.col("rank") == 2, -F.length("name")).otherwise(F.length("name"))
    last = near.groupBy("model").agg(F.max("k").alias("most"))  # the catalogue is asked for the other name only, if there is one
    near = near.join(last, "model").where((F.col("tab") == PRIMARY) | (F.col("k") == F.col("most")))
    level = _FUZZY + F.col("tab") * 100 + F.col("k") * 10 + F.col("s")
    found = near.groupBy("model").agg(F.min(F.struct(level.alias("level"), (-F.col("rank")).alias("r"), size.alias("l"), "name", "tab")).alias("f"))
    return found.select("model", F.struct("f.level", "f.tab", "f.name").alias("b"), F.lit(False).alias("direct"))
