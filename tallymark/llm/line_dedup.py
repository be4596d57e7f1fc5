"""Operator 5, line dedup: drop lines that stand on too large a share of their site's pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise, replace_columns

#: Largest number of boilerplate lines (8-byte hash, host) that may be broadcast to all tasks; about 64 MB.
BROADCAST_LINES = 1_000_000
#: Copies of a host's line list when it is joined by shuffle instead, so that no task gets a whole large host.
SALTS = 64


def boilerplate(df: DataFrame, text: str, host: str, max_ratio: float, min_pages: int) -> DataFrame:
    """(host, line hash) of the lines on at least min_pages pages and more than max_ratio of their host's pages.

    A line is counted once a page. Both counts combine on the map side, so neither a hot host nor a line that
    stands on every page gathers in one task. Lines are compared by 64-bit hash within their host: a page line
    is judged wrongly with a chance of the host's boilerplate lines over 2^64.
    """
    pages = df.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.length(F.trim(x)) > 0)
    hashes = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    on = (
        df.select(F.col(host).alias("host"), F.explode(hashes).alias("line"))
        .groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    )
    return (
        on.join(pages, on["host"].eqNullSafe(pages["host"]))
        .where(F.col("n") > F.lit(max_ratio) * F.col("pages")).select(on["host"], "line")
    )


def line_dedup(
    df: DataFrame, text: str = "text", host: str = "source", max_ratio: float = 0.1, min_pages: int = 5,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The rows of df with the boilerplate lines of their host taken out of the text.

    Adds n_lines and n_dropped (long). A column of df with one of these names is replaced; all others stay.
    Null text: stays null, n_lines 0. Empty text: one empty line, kept. Blank lines (spaces only) are never
    dropped. Null hosts form one site. Equal rows are separate pages. A page whose every non-blank line is
    boilerplate is left whole, so copies of one page don't erase each other (near-duplicate removal is for
    them). An empty table gives an empty table.
    """
    bad, path = materialise(boilerplate(df, text, host, max_ratio, min_pages), "boilerplate")
    lists = bad.groupBy("host").agg(F.collect_list("line").alias("__bad"))
    work = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(host).alias("__host"), F.col(text).alias("__text"))
    if bad.count() <= broadcast_lines:
        lists = F.broadcast(lists)
    else:
        lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        work = work.withColumn("__salt", F.pmod(F.xxhash64("__text"), F.lit(SALTS)).cast("int"))
    same = work["__host"].eqNullSafe(lists["host"])
    if "__salt" in work.columns:
        same = same & (work["__salt"] == lists["__salt"])
    split = F.split(F.col("__text"), "\n")
    out = work.join(lists, same, "left").select("__row", "__text", "__bad", split.alias("__lines"))
    kept = F.when(
        F.col("__bad").isNotNull(),
        F.filter("__lines", lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains(F.col("__bad"), F.xxhash64(x))),
    )
    out = out.select("__row", "__text", F.coalesce(F.size("__lines"), F.lit(0)).alias("__n"), kept.alias("__kept"))
    left = F.exists("__kept", lambda x: F.length(F.trim(x)) > 0)
    dropped = F.when(left & (F.size("__kept") < F.col("__n")), F.col("__n") - F.size("__kept"))
    out = out.select("__row", "__text", "__n", "__kept", dropped.alias("__dropped"))
    new = F.when(F.col("__dropped").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("__text"))
    out = out.select(
        *[F.col(f"__row.`{c}`") for c in df.columns], new.alias("__new"),
        F.greatest(F.col("__n"), F.lit(0)).cast("long").alias("__nl"), F.coalesce("__dropped", F.lit(0)).cast("long").alias("__nd"),
    )
    order = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*[F.col("__new").alias(c) if c == text else F.col(f"`{c}`") for c in order], F.col("__nl").alias("n_lines"), F.col("__nd").alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs.select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = """
WITH l AS (
  SELECT doc_id, source, list_transform(string_split(text, chr(10)), lambda x: x) AS lines FROM documents),
u AS (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: length(trim(x)) > 0))) AS line FROM l),
c AS (SELECT source, line, count(*) AS n FROM u GROUP BY source, line),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
  SELECT c.source, list(c.line) AS bad FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
  WHERE c.n >= 5 AND c.n > 0.1 * p.pages GROUP BY c.source),
k AS (
  SELECT d.doc_id, d.text, l.lines,
    list_filter(l.lines, lambda x: length(trim(x)) = 0 OR NOT list_contains(coalesce(b.bad, []), x)) AS kept
  FROM documents d JOIN l ON d.doc_id = l.doc_id LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM d.source),
r AS (SELECT *, len(list_filter(kept, lambda x: length(trim(x)) > 0)) > 0 AND len(kept) < len(lines) AS cut FROM k)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines,
  CASE WHEN cut THEN len(lines) - len(kept) ELSE 0 END::BIGINT AS n_dropped,
  CASE WHEN cut THEN array_to_string(kept, chr(10)) ELSE text END AS text
FROM r
"""
