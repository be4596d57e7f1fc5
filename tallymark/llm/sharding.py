"""Operator 12, sharding: proportional stratified interleaving, so that every shard has the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import duck
from .common import materialise

SHARDS = 16
SEED = 20240229
#: Rows that a bucket of a ranking holds on average, and the most buckets a ranking (their counts are one small table).
BUCKET_ROWS, MOST_BUCKETS = 500, 1 << 16
#: Order of the rows of a source: the seeded shuffle, then what tells apart rows of one doc_id.
_SHUFFLED = ["__key", "doc_id", "text_crc32", "size"]


def _facts_of(text: Column, source: Column, doc_id: Column, seed: int) -> tuple[Column, Column, Column, Column]:
    """Stratum, size, checksum and the key in the seeded shuffle of a row."""
    octets = F.coalesce(text, F.lit("")).cast("binary")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary"))
    return F.coalesce(source.cast("string"), F.lit("")), (F.octet_length(octets) + 1).cast("long"), F.crc32(octets), key


def _numbered(df: DataFrame, groups: list[str], bucket: Column, order: list[str], name: str) -> DataFrame:
    """df with each row's place (from 0) in its group by `order`, and __rows of the group; `bucket` rises with the order and cuts a group evenly.

    A row's place is the number of rows in earlier buckets and its number in its own. So no group is ever sorted
    by one task: only buckets are, whose keys are hashes or fractional ranks and therefore spread evenly, also
    those of a source that holds a third of all rows. Counts of buckets are at most MOST_BUCKETS a group.
    """
    keys = [*groups, "__bucket"]
    work = df.withColumn("__bucket", bucket)
    counts = work.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy(*groups)).alias("__rows"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = work.withColumn("__own", own).join(starts, keys)
    return out.select(*df.columns, (F.col("__start") + F.col("__own") - 1).cast("long").alias(name), "__rows")


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket holds about BUCKET_ROWS rows until there are MOST_BUCKETS."""
    n = 1
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, stratum, size, text_crc32, rank, position, shard, slot) of every row of docs, in proportion to the sources.

    Rows are shuffled within their source by a seeded hash of the doc_id and ranked there; all rows are ordered by
    fractional rank (rank + 1/2) / (rows of the source), ties by source and rank, and cut into `shards` runs whose
    counts differ by one at most. Any run of a source's share holds its rows to within one or two.
    slot is the place in the shard, from 0. size is the text's UTF-8 bytes plus 1.

    Null text: no bytes. Null source: the source ''. Null doc_id: hashed as none, it has a place like others. Rows of
    one doc_id: ordered by checksum and size; equal rows take neighbouring ranks, one each. An empty table gives an
    empty one. Other columns, whatever their names, play no part; texts don't move.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")
    stratum, size, crc, key = _facts_of(F.col(text), F.col(source), F.col(doc_id), seed)
    slim = docs.select(F.col(doc_id).alias("doc_id"), stratum.alias("stratum"), size.alias("size"), crc.alias("text_crc32"), key.alias("__key"))
    facts, _ = materialise(slim, "shard-facts")
    total = facts.count()
    many = buckets_for(total)
    by_hash = F.floor(F.conv(F.substring("__key", 1, 4), 16, 10).cast("long") * many / (1 << 16))
    ranked = _numbered(facts, ["stratum"], by_hash, _SHUFFLED, "rank")
    share = (2 * F.col("rank") + 1).cast("double") / (2 * F.col("__rows")).cast("double")
    ranked, _ = materialise(ranked.withColumn("__share", share).drop("__key", "__rows"), "shard-ranks")
    everyone = _numbered(ranked, [], F.floor(F.col("__share") * many).cast("long"), ["__share", "stratum", "rank"], "position")
    out = everyone.withColumn("shard", F.expr(f"cast((position * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")  # the least position of the shard
    return out.select("doc_id", "stratum", "size", "text_crc32", "rank", "position", "shard", (F.col("position") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> None:
    """Write docs as Parquet, a folder `shard=k` each, with the columns of docs and `slot`; files of a shard hold consecutive slots in order.

    Placements meet the texts once, by doc_id, checksum, size and source; rows that agree in all of these are told apart by number.
    """
    same = ["__id", "__stratum", "__size", "__crc"]
    at = interleave(docs, shards, seed, doc_id, text, source).select(F.col("doc_id").alias("__id"), F.col("stratum").alias("__stratum"), F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "slot")
    at = at.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy("shard", "slot")))
    stratum, size, crc, _ = _facts_of(F.col(text), F.col(source), F.col(doc_id), seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    facts = docs.select(row.alias("__row"), F.col(doc_id).alias("__id"), stratum.alias("__stratum"), size.alias("__size"), crc.alias("__crc"))
    facts = facts.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0))))
    both = facts.join(at, facts["__nth"].eqNullSafe(at["__nth"]) & (facts["__crc"] == at["__crc"]) & (facts["__size"] == at["__size"]) & facts["__id"].eqNullSafe(at["__id"]) & (facts["__stratum"] == at["__stratum"]))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = both.select(*[F.col(f"__row.`{c}`") for c in kept], "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by the law `rows`; grown_shard is for shards by key and stays null."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return interleave(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE = f"""WITH {duck.CRC_TABLE},
f AS (SELECT doc_id, coalesce(source, '') AS stratum, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {duck.crc32("coalesce(text, '')")}::BIGINT AS text_crc32, md5('{SEED}:' || doc_id) AS k FROM documents, crc),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id, text_crc32, size) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS n, count(*) OVER () AS total FROM f),
p AS (SELECT *, row_number() OVER (ORDER BY (2 * rank + 1)::DOUBLE / (2 * n)::DOUBLE, stratum, rank) - 1 AS position FROM r),
s AS (SELECT *, position * {SHARDS} // total AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (row_number() OVER (PARTITION BY shard ORDER BY position) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""
