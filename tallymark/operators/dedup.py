"""Removal of replayed and duplicated requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import forget, written


def keep_best(df: DataFrame, keys: list[str], order: list[Column], when: Column | None = None) -> DataFrame:
    """One row of each key: the greatest by `order`. Rows for which `when` is false are all kept.

    An aggregation with max_by combines on the map side, so a hot key costs one row a task, where a window
    would bring all its rows to one.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = df.where(when if when is not None else F.lit(True)).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("r")
    ).select("r.*")
    return out if when is None else out.unionByName(df.where(~F.coalesce(when, F.lit(False))))


def first_of(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return keep_best(df, keys, [-F.col(seq)])


def last_of(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    return keep_best(df, keys, [F.col(seq)])


def first_by(df: DataFrame, keys: list[str], order: list[str | Column], when: Column | None = None) -> DataFrame:
    """The first row of each key by columns such as (source_file, seq). Rows for which `when` is not true are all kept."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    out = df.where(when if when is not None else F.lit(True)).groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*order)).alias("r")
    ).select("r.*")
    return out if when is None else out.unionByName(df.where(~F.coalesce(when, F.lit(False))))


def best_request(df: DataFrame, tokens: Column) -> DataFrame:
    """Rows with a message id: of each (message, request) the main chain before a sidechain, then most tokens, then fast, then first."""
    order = [~F.col("is_sidechain"), tokens, F.col("fast"), -F.col("seq")]
    return keep_best(df, ["message_id", "request_id"], order, F.col("message_id").isNotNull())


def without_replays(df: DataFrame, tokens: Column) -> DataFrame:
    """best_request, then replays: of one (message, session, time) a sidechain row goes when the main chain has the request."""
    best = best_request(df, tokens)
    main = best.where(~F.col("is_sidechain") & F.col("message_id").isNotNull()).select("message_id", "session_id", "ts_ms").distinct()
    side = best.where(F.col("is_sidechain")).join(main, ["message_id", "session_id", "ts_ms"], "left_anti").select(*best.columns)
    return best.where(~F.col("is_sidechain")).unionByName(side)


def components(edges: DataFrame, a: str, b: str, rounds: int = 40) -> DataFrame:
    """(node, root) of an undirected graph by propagation of least labels with pointer jumping.

    Each round is a map-side combined aggregation whose labels are written to the shared folder, so the plan doesn't grow
    with the rounds and a lost executor costs a reread. Ends when no label changes; raises if labels still move after
    `rounds` rounds.
    """
    spark = edges.sparkSession
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct()
    both, _ = written(both, "edges")
    label, path = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root")), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = label.join(near, "x").select("x", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        far = label.join(near, "x").select(F.col("x").alias("root"), F.least("root", "r").alias("far"))
        hop = step.join(far, "root", "left").select("x", F.coalesce("far", "root").alias("root"), (F.coalesce("far", "root") != F.col("old")).alias("moved"))
        hop, hop_path = written(hop, "labels")
        forget(spark, path)
        label, path = hop.drop("moved"), hop_path
        if hop.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select(F.col("x").alias("node"), "root")
