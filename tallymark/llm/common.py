"""Helpers shared by the corpus operators: scratch tables, column hygiene, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import python_ready

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java regular expression.
WS = r"[\x20\x09-\x0D]+"

_FALLBACK: dict[str, str] = {}


#: Bytes of an Arrow batch at most (a longer row stands alone): what a Python worker and its task hold of long texts.
BATCH_BYTES = 8 << 20


def at_most(spark: SparkSession, key: str, limit: int) -> None:
    """Lower a size among the session's settings to `limit`, if it is larger."""
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))


def workers_ready(spark: SparkSession) -> None:
    """The package on the executors, and the session's Arrow batches bounded in bytes on every path, also of returned plans."""
    python_ready(spark)
    at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _FALLBACK.setdefault("root", tempfile.mkdtemp(prefix="tallymark-scratch-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/tallymark/{name}-{uuid.uuid4().hex}"


#: Spark settings while a table is written: a query's shuffle files go when it has ended, and Arrow batches hold so
#: many rows at most, which bounds what a Python worker and its task hold of long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def materialise(df: DataFrame, name: str, mode_options: dict | None = None) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The plan of df runs once, so its shuffle files go as soon as the table is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    for key, value in (mode_options or {}).items():
        writer = writer.option(key, value)
    before = {k: spark.conf.get(k) for k in WRITING}
    for key, value in WRITING.items():
        spark.conf.set(key, value)
    try:
        writer.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no returned plan reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; null for a null text."""
    return F.array_remove(F.split(text, WS), "")


def pieces(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of an Arrow batch, each with about `limit` bytes at most, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def in_share(key: Column, share: float) -> Column:
    """Whether a row's 64-bit hash of `key` lies in the lowest `share` of all hashes: an even choice of rows."""
    return F.xxhash64(key) <= F.lit(min(2**63 - 1, int(share * 2.0**64) - 2**63))


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns; a column of the input with the same name (in any case) gives way to the new one."""
    taken = {n.lower() for n in new}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in new.items()])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: columns a, b in; (node, root) out, root the least node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014). A round only ever keeps rows
    (node, smaller neighbour), so a hub is spread over its neighbours' keys instead of being gathered, and
    the number of rounds grows with the logarithm of the size. Each round is cut with a written table.
    Isolated nodes don't appear. Nulls are ignored.
    """
    spark = edges.sparkSession
    pairs = (
        edges.select("a", "b").where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    pairs, path = materialise(pairs, "cc")
    old_sum = None
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        nxt = small.union(low2.select("a", F.col("m").alias("b"))).distinct()
        nxt, nxt_path = materialise(nxt, "cc")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
        drop_path(spark, path)
        pairs, path = nxt, nxt_path
        if (row["n"], row["s"]) == old_sum:
            break
        old_sum = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not settle")
    low = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return low.union(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
