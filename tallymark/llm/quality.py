"""Operator 7, quality rules: word and line statistics held against thresholds that adapt to language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WS, materialise, words

#: Whole-number statistics of a document that the adaptive thresholds bound, with the side that fails.
METRICS = {"mean_len": "both", "symbols": "high", "dup_lines": "high", "repeats": "high"}
#: A threshold lies `spread` interquartile ranges (or `least` units, where that is more) beyond a quartile.
SPREAD, LEAST = 3, {"mean_len": 10, "symbols": 100, "dup_lines": 500, "repeats": 250}
#: Sub-buckets for each power of two in the sketch: a bucket's values differ by at most 1 in 32.
SUB_BITS = 5
#: Groups with fewer documents than this are judged by the sketch of their language, merged over sources.
MIN_GROUP = 20


def _pairs(hashes: Column, shift: int, n: Column) -> Column:
    """Hash of element i with element i + shift, for as many i as there are."""
    joined = F.zip_with(hashes, F.slice(hashes, F.lit(shift + 1), n), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    return F.slice(joined, F.lit(1), F.greatest(n - shift, F.lit(0)))


def base_statistics(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """df's rows (columns `carry`, as struct `__row`) with the counts of the rules; Spark expressions only.

    Windows of eight words are hashed by doubling (1, 2, 4, 8 words) and compared by 64-bit hash within a
    document. Only documents with a repeated window sort their windows to find which words those cover.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in (carry or df.columns)]).alias("__row")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    work = df.select(
        row, F.length(F.regexp_replace(t, WS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("__lines"),
        F.transform(words(t), lambda w: F.xxhash64(w)).alias("__h"),
    )
    keep = ["__row", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words"]
    work = work.select(
        "__row", "word_chars", "n_symbols", F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__h").cast("long").alias("n_words"), F.size("__h").alias("__n"), "__h",
    )
    long_enough = F.col("__n") >= 8
    work = work.select(*keep, "__n", F.when(long_enough, _pairs(F.col("__h"), 1, F.col("__n"))).alias("__2"))
    work = work.select(*keep, "__n", F.when(long_enough, _pairs(F.col("__2"), 2, F.col("__n") - 1)).alias("__4"))
    work = work.select(*keep, F.when(long_enough, _pairs(F.col("__4"), 4, F.col("__n") - 3)).alias("__8"))
    twice = F.size(F.array_distinct("__8")) < F.size("__8")
    placed = F.sort_array(F.transform("__8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    work = work.select(*keep, F.when(twice, placed).alias("__w"))
    again = F.filter(
        "__w",
        lambda x, k: ((k > 0) & (F.get(F.col("__w"), k - 1)["h"] == x["h"])) | F.coalesce(F.get(F.col("__w"), k + 1)["h"] == x["h"], F.lit(False)),
    )
    work = work.select(*keep, F.sort_array(F.transform(again, lambda x: x["i"])).alias("__p"))
    steps = F.zip_with("__p", F.slice("__p", F.lit(2), F.size("__p")), lambda a, b: F.least(F.lit(8), F.coalesce(b - a, F.lit(8))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return work.select(*keep, F.when(F.size("__p") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def _metrics() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    return [
        F.floor(10 * F.col("word_chars") / n).cast("long").alias("mean_len"),
        F.floor(1000 * F.col("n_symbols") / n).cast("long").alias("symbols"),
        F.floor(1000 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).cast("long").alias("dup_lines"),
        F.floor(1000 * F.col("n_repeat_words") / n).cast("long").alias("repeats"),
    ]


def _bucket(v: Column) -> Column:
    """Number of the sketch bucket that holds the whole number v >= 0; order-preserving."""
    bits = F.length(F.bin(v)).cast("long")
    extra = F.greatest(bits - (SUB_BITS + 1), F.lit(0))
    low = F.floor(v / F.pow(F.lit(2.0), extra)).cast("long")
    return extra * (1 << SUB_BITS) + low


def _floor_of(bucket: Column) -> Column:
    """Least whole number of a bucket."""
    extra = F.greatest(F.floor(bucket / (1 << SUB_BITS)) - 1, F.lit(0))
    return ((bucket - extra * (1 << SUB_BITS)) * F.pow(F.lit(2.0), extra)).cast("long")


def thresholds(stats: DataFrame) -> DataFrame:
    """(lang, source, and low and high of each metric) from mergeable quantile sketches.

    A sketch is a table of bucket counts (relative error 1/32, at most a few hundred buckets), so sketches
    merge by adding counts: those of a language are the sums of its sources'. Unlike a sampling sketch the
    result doesn't depend on the order of merging. Groups under MIN_GROUP documents use their language's.
    """
    long = stats.where(~F.col("base_failed")).select(
        F.col("__lang").alias("lang"), F.col("__source").alias("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(F.col(m)).alias("bucket")) for m in METRICS])).alias("x"),
    )
    fine = long.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))
    coarse = fine.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))

    def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys, "metric")
        run = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
        at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
        out = run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))
        return out.select(*keys, "metric", "total", _floor_of(F.col("q1")).alias("q1"), _floor_of(F.col("q3")).alias("q3"))

    least = F.create_map(*[x for m, v in LEAST.items() for x in (F.lit(m), F.lit(v))])[F.col("metric")]
    gap = F.greatest(SPREAD * (F.col("q3") - F.col("q1")), least)

    def wide(q: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        aggs = [F.max("total").alias(f"{prefix}total")]
        for m in METRICS:
            aggs.append(F.max(F.when(F.col("metric") == m, F.col("q1") - gap)).alias(f"{prefix}{m}_low"))
            aggs.append(F.max(F.when(F.col("metric") == m, F.col("q3") + gap)).alias(f"{prefix}{m}_high"))
        return q.groupBy(*keys).agg(*aggs)

    own, whole = wide(quartiles(fine, ["lang", "source"]), ["lang", "source"], "o_"), wide(quartiles(coarse, ["lang"]), ["lang"], "l_")
    both = own.join(whole.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")))
    pick = lambda c: F.when(F.col("o_total") >= MIN_GROUP, F.col(f"o_{c}")).otherwise(F.col(f"l_{c}")).alias(c)
    return both.select("lang", "source", *[pick(f"{m}_{s}") for m in METRICS for s in ("low", "high")])


def quality(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """df's rows (the columns in carry, or all) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    base_failed: fewer than 20 words, or over 30 in 100 words inside repeated windows of eight. kept: not
    base_failed and within the thresholds of the document's language and source. Null and empty texts have
    no words and fail. Null languages and null sources are groups of their own. Columns of df with these
    names are replaced. Equal rows are judged alike. An empty table gives an empty table.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    carry = list(dict.fromkeys([*(carry or df.columns), lang, source]))
    base = base_statistics(df, text, carry)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = base.select("*", *_metrics(), failed.alias("base_failed"), F.col(f"__row.`{lang}`").alias("__lang"), F.col(f"__row.`{source}`").alias("__source"))
    stats, _ = materialise(stats, "quality")
    limits = thresholds(stats)
    ok = F.lit(True)
    for m, side in METRICS.items():
        ok = ok & (F.col(m) <= F.col(f"{m}_high"))
        if side == "both":
            ok = ok & (F.col(m) >= F.col(f"{m}_low"))
    out = stats.join(limits, stats["__lang"].eqNullSafe(limits["lang"]) & stats["__source"].eqNullSafe(limits["source"]), "left")
    out = out.withColumn("kept", ~F.col("base_failed") & F.coalesce(ok, F.lit(False)))
    rest = [F.col(f"__row.`{c}`") for c in carry if c.lower() not in names]
    return out.select(*rest, *names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # The text is needed for counting only: statistics travel without it.
    return quality(docs, carry=["doc_id", "lang", "source"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """DuckDB SQL: the same counts by plain lists, and the same sketch."""
    bucket = lambda v: f"(greatest(length(bin({v})) - 6, 0) * 32 + floor({v} / power(2.0, greatest(length(bin({v})) - 6, 0)))::BIGINT)"
    extra = lambda b: f"greatest(({b} // 32) - 1, 0)"
    floor_of = lambda b: f"(({b} - {extra(b)} * 32) * power(2.0, {extra(b)}))::BIGINT"
    least = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in LEAST.items()) + " END"
    wide = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN q1 - gap END) AS {m}_low, max(CASE WHEN metric = '{m}' THEN q3 + gap END) AS {m}_high" for m in METRICS
    )
    pick = ", ".join(f"CASE WHEN o.total >= {MIN_GROUP} THEN o.{m}_{s} ELSE w.{m}_{s} END AS {m}_{s}" for m in METRICS for s in ("low", "high"))
    inside = " AND ".join(f"s.{m} <= t.{m}_high" + (f" AND s.{m} >= t.{m}_low" if side == "both" else "") for m, side in METRICS.items())
    quart = lambda keys, frm: f"""(  -- quartile buckets of each sketch
  SELECT {keys}, metric, max(total) AS total, {floor_of("min(CASE WHEN upto * 4 >= total THEN bucket END)")} AS q1,
    {floor_of("min(CASE WHEN upto * 4 >= total * 3 THEN bucket END)")} AS q3
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, metric) AS total, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY bucket) AS upto FROM {frm})
  GROUP BY {keys}, metric)"""  # noqa: E731
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
b AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n_repeat, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
s AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, 10 * word_chars // greatest(n_words, 1) AS mean_len,
    1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats FROM b),
m AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {bucket(m)} AS bucket FROM s WHERE NOT base_failed" for m in METRICS)}),
fine AS (SELECT lang, source, metric, bucket, count(*) AS n FROM m GROUP BY ALL),
coarse AS (SELECT lang, metric, bucket, sum(n) AS n FROM fine GROUP BY ALL),
o AS (SELECT lang, source, max(total) AS total, {wide} FROM (SELECT *, greatest({SPREAD} * (q3 - q1), {least}) AS gap FROM {quart("lang, source", "fine")}) GROUP BY lang, source),
w AS (SELECT lang, {wide} FROM (SELECT *, greatest({SPREAD} * (q3 - q1), {least}) AS gap FROM {quart("lang", "coarse")}) GROUP BY lang),
t AS (SELECT o.lang, o.source, {pick} FROM o JOIN w ON o.lang IS NOT DISTINCT FROM w.lang)
SELECT s.doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, s.base_failed,
  NOT s.base_failed AND coalesce({inside}, FALSE) AS kept
FROM s LEFT JOIN t ON s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source
"""


ORACLE = _oracle()
