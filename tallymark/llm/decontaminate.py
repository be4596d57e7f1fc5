"""Operator 10, benchmark decontamination: find benchmark items in documents, also with other numbers and names.

Words become template words: numbers, names and units turn into typed placeholders, other words lose case and
punctuation. A run of names, or of numbers and their units, is one template word, as its values may have another
number of words. Windows of eight template words of the items are hash-joined with those of the documents; where
enough windows of an item meet near one alignment, its slots are checked: one value must stand for one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialise, words

WINDOW = 8
#: Share of an item's windows that must meet near one alignment, and least agreement of its slots.
COVERAGE, AGREEMENT = 0.5, 0.75
#: Windows whose shifts differ from an alignment's by so many words count with it: words may be dropped or added.
SLACK = 8
#: Items with fewer template words than a window and fewer other words than this are sought without joining runs.
LITERALS = 4
#: Items with fewer words besides the placeholders, and fewer than LITERALS words in all, are not sought: a value alone
#: would be found in every text with one.
LEAST_LITERALS = 2
#: Largest number of item windows that may be broadcast (about 24 bytes each in a hashed table of 64 bytes).
BROADCAST_WINDOWS = 1_000_000

#: Units of measure and currency that may follow or join a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh percent % dollar dollars cent cents euro euros usd eur gbp"
).split()
#: English words for numbers ("one" is more often a pronoun); "twenty-one" and the like are made from them.
NUMBER_WORDS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_BY_WORD = [*NUMBER_WORDS, *TENS, *[f"{t}-{n}" for t in TENS for n in ["one", *NUMBER_WORDS[1:9]]]]
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
#: Where a sentence or a line ends, and what tells it from a heading: a word in lower case other than these.
_ENDS = r"\n|[ \t\r](?<=[.!?:'\")\]][ \t\r])"
_PROSE = r"(?:^|[\x20\x09-\x0D('\"])(?!(?:a|an|and|at|by|for|from|in|is|of|on|or|the|to|with)\b)\p{Ll}"
_FOUR_WORDS = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){3}[^\x20\x09-\x0D]"
_SMALL = r"^\p{Ll}+\z"
_EDGE = r"^[^\p{L}\p{N}%]+|[^\p{L}\p{N}%]+$"


def _read(text: Column) -> Column:
    """Words of a text. Capitals tell nothing in a heading, or where all is in capitals: such a sentence or line of four words or more loses case."""
    parts = F.transform(F.split(text, _ENDS), lambda x: F.when(~x.rlike(_PROSE) & x.rlike(_FOUR_WORDS), F.lower(x)).otherwise(x))
    return words(F.array_join(parts, " "))


def _core(w: Column) -> Column:
    """A word without the signs around it; most words are small letters alone and need no replacement."""
    return F.when(w.rlike(_SMALL), w).otherwise(F.regexp_replace(w, _EDGE, ""))


def _templates(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys with `ws`, the words of a text, and `ts`, the template word of each.

    A name is a word with a capital that doesn't begin a sentence; a number has a digit or is an English word for one.
    """
    parts = lambda c: F.struct(c.alias("c"), F.lower(c).alias("l"), (F.lower(c).isin(_BY_WORD) | c.rlike("[0-9]")).alias("n"))

    def one(x: Column, i: Column) -> Column:
        starts = (i == 0) | F.get(F.col("ws"), i - 1).rlike(r"[.!?:]['\")\]]*$")
        return (
            F.when(x["n"], F.lit(NUMBER))
            .when((i > 0) & F.get(F.col("xs"), i - 1)["n"] & x["l"].isin(UNITS), F.lit(UNIT))
            .when((x["l"] != x["c"]) & ~starts, F.lit(NAME))
            .otherwise(x["l"])
        )

    # A column that a later step names twice is evaluated once and never again inside a lambda: so in steps, each word once.
    df = df.select(*keys, _read(F.col(text)).alias("ws"))
    df = df.select(*keys, "ws", F.transform(F.transform("ws", _core), parts).alias("xs"))
    return df.select(*keys, "ws", F.transform("xs", one).alias("ts"))


def _joined(a: str, b: str, shift: int) -> Column:
    """Hash of a[i] with b[i + shift] for as many i as there are."""
    z = F.zip_with(F.col(a), F.slice(F.col(b), F.lit(shift + 1), F.greatest(F.size(b) - shift, F.lit(0))), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
    return F.slice(z, F.lit(1), F.greatest(F.size(b) - shift, F.lit(0)))


def _windows(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys with `w`: hashes of the windows of `width` words from `h`, built by doubling."""
    have, df = {1: "h"}, df.select(*keys, "h")
    size = 1
    while size * 2 <= width:
        df = df.select(*keys, *have.values(), _joined(have[size], have[size], size).alias(f"h{size * 2}"))
        size *= 2
        have[size] = f"h{size}"
    total, name = size, have[size]
    for part in sorted((k for k in have if k < size), reverse=True):
        if total + part <= width:
            df = df.select(*keys, *have.values(), *([name] if name not in have.values() else []), _joined(name, have[part], total).alias(f"w{total + part}"))
            total, name = total + part, f"w{total + part}"
    return df.select(*keys, F.col(name).alias("w"))


def _begins(x: Column, before: Column, number: Column, name: Column, unit: Column) -> Column:
    """Whether x begins a template word, given the placeholder or word before it (not null)."""
    return ~((x == unit) | ((x == number) & before.isin(number, unit)) | ((x == name) & (before == name)))


def _hashed(df: DataFrame, keys: list[str], text: str, joined: bool) -> DataFrame:
    """keys with `h`: hashes of the template words; with `joined` a run of placeholders is one."""
    h = _templates(df, keys, text).select(*keys, F.transform("ts", lambda x: F.xxhash64(x)).alias("h"))
    if not joined:
        return h
    marks = [F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT)]
    return h.select(*keys, F.filter("h", lambda x, i: _begins(x, F.coalesce(F.get(F.col("h"), i - 1), F.lit(0)), *marks)).alias("h"))


def _tokens(df: DataFrame, keys: list[str], text: str, joined: bool) -> DataFrame:
    """keys with `tok`: the template words (t), and of a placeholder the value (v) and the units (u) of its run."""
    df = _templates(df, keys, text).select(*keys, F.col("ws").alias("w"), F.col("ts").alias("t"))
    at = F.transform("t", lambda x, i: i)
    if joined:
        marks = [F.lit(x) for x in (NUMBER, NAME, UNIT)]
        at = F.filter(at, lambda i: _begins(F.get(F.col("t"), i), F.coalesce(F.get(F.col("t"), i - 1), F.lit("")), *marks))
    df = df.select(*keys, F.transform("w", lambda w: F.lower(_core(w))).alias("w"), "t", at.alias("at"))

    def values(lo: Column, hi: Column, kind: Column) -> Column:
        run = F.zip_with(F.slice("w", lo + 1, hi - lo), F.slice("t", lo + 1, hi - lo), lambda w, t: F.when(t == kind, w))
        return F.array_join(F.filter(run, lambda x: x.isNotNull()), " ")

    def one(lo: Column, after: Column) -> Column:
        kind, hi = F.get(F.col("t"), lo), F.coalesce(after, F.size("t"))
        slot = kind.isin(NUMBER, NAME, UNIT)
        return F.struct(kind.alias("t"), F.when(slot, values(lo, hi, kind)).alias("v"), F.when(kind == NUMBER, values(lo, hi, F.lit(UNIT))).alias("u"))

    return df.select(*keys, F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), one).alias("tok"))


def find_leaks(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
    coverage: float = COVERAGE, agreement: float = AGREEMENT, broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_matched, n_slots, n_changed, agreement) of each item found.

    n_windows: windows of the item; n_matched: those that meet near the best alignment whose slots agree, within
    SLACK words; n_slots: values (of numbers, names and units) there in both; n_changed: those that differ.
    agreement: the fewer of the item's and the document's distinct slot values over their distinct pairs (1: one
    value for one value; 1 too without slots). Every alignment with enough windows is checked.
    Items of fewer than eight template words are sought by one window of their own length; where joining runs
    leaves fewer than LITERALS words besides the placeholders of such an item, its runs aren't joined and its values
    must be the same. Items with fewer than LEAST_LITERALS words besides the placeholders and fewer than LITERALS in
    all are in no text.
    A sentence or line of four words or more, none of them in lower case but for small words like "of", is read without
    case, so that headings and texts in capitals hold what they say and not a row of names.
    Null and empty texts and items hold and are nothing. Rows are told apart by (doc_id, hash of the text); equal
    rows count once; a null doc_id is an id. Repeated item rows count once. Other columns aren't read. Empty tables
    give an empty table. Items are bounded by a count before they are broadcast; beyond it windows meet by shuffle.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    it = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).distinct()
    # Written first: filters on what is computed from the words would be pushed down and evaluate them anew for each place they name.
    it, _ = materialise(_hashed(it.where("t is not null"), ["item_id", "t"], "t", True), "item-words")
    marks = [F.xxhash64(F.lit(x)) for x in (NUMBER, NAME, UNIT, "")]
    literals = F.size(F.filter("h", lambda x: ~x.isin(*marks)))
    joined = (F.size("h") >= WINDOW) | (literals >= LITERALS)
    enough = (literals >= LEAST_LITERALS) | (F.size(words(F.col("t"))) >= LITERALS)
    it = it.where(enough).select("item_id", "t", joined.alias("joined"), F.when(joined, F.size("h")).otherwise(F.size(words(F.col("t")))).alias("n"))
    it, _ = materialise(it.where("n > 0"), "sought")
    modes = sorted(r["joined"] for r in it.select("joined").distinct().collect()) or [True]
    out = None
    for mode in modes:
        found = _find(d, it.where(F.col("joined") == mode), mode, coverage, agreement, broadcast_windows)
        out = found if out is None else out.union(found)
    return out


def _find(d: DataFrame, it: DataFrame, joined: bool, coverage: float, agreement: float, broadcast_windows: int) -> DataFrame:
    """find_leaks for items that are all sought with their runs joined, or all without."""
    keys = ["doc_id", "text_hash"]
    widths = sorted({min(WINDOW, r["n"]) for r in it.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()}) or [WINDOW]
    dh = _hashed(d, keys, "t", joined)
    hits = None
    for width in widths:
        mine = it.where(F.least("n", F.lit(WINDOW)) == width)
        # The outer form, as the plain one gets a filter that the optimizer would push below the doubling and evaluate anew.
        sought = _windows(_hashed(mine, ["item_id"], "t", joined), ["item_id"], width)
        sought = sought.select("item_id", F.size("w").alias("n_windows"), F.posexplode_outer("w").alias("ipos", "w"))
        sought, _ = materialise(sought, "items")
        small = sought.count() <= broadcast_windows
        there = _windows(dh, keys, width).select(*keys, F.posexplode_outer("w").alias("dpos", "w"))
        found = there.join(F.broadcast(sought) if small else sought, "w")
        found = found.select(*keys, "item_id", "n_windows", "ipos", (F.col("dpos") - F.col("ipos")).cast("long").alias("shift"), F.lit(width).alias("width"))
        hits = found if hits is None else hits.union(found)
    per = hits.groupBy(*keys, "item_id", "shift").agg(F.collect_set("ipos").alias("at"), F.first("n_windows").alias("n_windows"), F.first("width").alias("width"))

    # Of each alignment the windows that meet within SLACK words of it, as stretches (lo, hi, shift) of the item.
    ends = F.sort_array("at")
    lone = lambda step: F.filter(ends, lambda x: ~F.array_contains(F.col("at"), x + step))
    runs = F.zip_with(lone(-1), lone(1), lambda a, b: F.struct(a.alias("lo"), (b + F.col("width")).alias("hi"), F.col("shift").alias("shift")))
    per = per.select(*keys, "item_id", "shift", "n_windows", "at", runs.alias("runs"))
    near = Window.partitionBy(*keys, "item_id").orderBy("shift").rangeBetween(-SLACK, SLACK)
    lines = per.select(
        *keys, "item_id", "shift", "n_windows", F.size(F.array_distinct(F.flatten(F.collect_list("at").over(near)))).alias("n_matched"),
        F.flatten(F.collect_list("runs").over(near)).alias("runs"),
    )
    lines = lines.where(F.col("n_matched") >= F.ceil(F.lit(coverage) * F.col("n_windows")))
    lines = lines.groupBy(*keys, "item_id").agg(F.collect_list(F.struct("shift", "n_windows", "n_matched", "runs")).alias("lines"))
    lines, _ = materialise(lines, "aligned")

    # Slots of the few pairs that are left: values of the item against those of the document, by the stretch nearest to each.
    wanted = lines.select(*keys).distinct()
    same = d["doc_id"].eqNullSafe(wanted["doc_id"]) & (d["text_hash"] == wanted["text_hash"])
    texts = _tokens(d.join(wanted, same, "left_semi").dropDuplicates(keys), keys, "t", joined)
    b, x = lines.alias("b"), _tokens(it, ["item_id"], "t", joined).alias("i")
    full = b.join(texts.alias("d"), F.col("b.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("b.text_hash") == F.col("d.text_hash"))).join(
        x, F.col("b.item_id").eqNullSafe(F.col("i.item_id"))
    ).select("b.*", F.col("d.tok").alias("dt"), F.col("i.tok").alias("it"))
    # Of the document only the stretch around an alignment goes on with it.
    first = lambda a: F.greatest(a["shift"] - SLACK, F.lit(0)).cast("int")
    part = F.transform("lines", lambda a: F.struct(a.alias("a"), first(a).alias("from"), F.slice("dt", first(a) + 1, F.size("it") + 2 * SLACK).alias("part")))
    full = full.select(*keys, "item_id", "it", F.explode(part).alias("p")).select(*keys, "item_id", "it", "p.a.*", "p.from", "p.part")

    def away(r: Column, k: Column) -> Column:
        gap = F.greatest(r["lo"] - k, k - r["hi"] + 1, F.lit(0))
        return F.struct(gap.alias("gap"), F.abs(r["shift"] - F.col("shift")).alias("off"), r["shift"].alias("shift"))

    paired = F.transform("it", lambda x, k: F.struct(
        x.alias("x"), F.when(x["v"].isNotNull(), (k + F.array_min(F.transform("runs", lambda r: away(r, k)))["shift"] - F.col("from")).cast("int")).alias("at")))
    full = full.select(*keys, "item_id", "shift", "n_windows", "n_matched", "part", F.filter(paired, lambda p: p["at"] >= 0).alias("p"))
    pairs = F.transform("p", lambda p: F.struct(p["x"].alias("x"), F.get(F.col("part"), p["at"]).alias("y")))
    full = full.select(*keys, "item_id", "shift", "n_windows", "n_matched", F.filter(pairs, lambda p: p["x"]["t"] == p["y"]["t"]).alias("p"))
    values = lambda f: F.transform("p", lambda p: F.struct(p["x"][f].alias("a"), p["y"][f].alias("b")))
    slots = F.concat(values("v"), F.filter(values("u"), lambda q: (q["a"] != "") & (q["b"] != "")))
    full = full.select(*keys, "item_id", "shift", "n_windows", "n_matched", slots.alias("s"))
    n_pairs, n_a, n_b = (F.size(F.array_distinct(x)) for x in (F.col("s"), F.transform("s", lambda x: x["a"]), F.transform("s", lambda x: x["b"])))
    out = full.select(
        *keys, "item_id", F.col("n_windows").cast("long"), F.col("n_matched").cast("long"), F.size("s").cast("long").alias("n_slots"),
        F.size(F.filter("s", lambda x: x["a"] != x["b"])).cast("long").alias("n_changed"),
        F.when(n_pairs > 0, F.least(n_a, n_b) / n_pairs).otherwise(F.lit(1.0)).alias("agreement"), (-F.col("shift")).alias("back"),
    ).where((F.col("agreement") >= agreement) if joined else (F.col("n_changed") == 0))
    best = F.max(F.struct("n_matched", "agreement", "back", "n_windows", "n_slots", "n_changed")).alias("b")
    return out.groupBy(*keys, "item_id").agg(best).select(*keys, "item_id", *[f"b.{c}" for c in ("n_windows", "n_matched", "n_slots", "n_changed", "agreement")])


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no item is found; all columns stay."""
    bad = find_leaks(docs, items, text, doc_id, **options).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[text]) == bad["__hash"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")
