"""Joins of the usage pipeline: precedence cascades, fork prefixes and time-bounded anti-joins."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cascade(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of levels by precedence: a level's rows go where an earlier level kept a row with one of the keys.

    Any key alone is enough (trace or response id); null keys match nothing.
    """
    kept = levels[0]
    for level in levels[1:]:
        for k in keys:
            seen = kept.where(F.col(k).isNotNull()).select(k).distinct()
            level = level.join(seen, k, "left_anti").select(*kept.columns)
        kept = kept.unionByName(level)
    return kept


def foremost(rows: DataFrame, level: str, keys: list[str], within: list[str]) -> DataFrame:
    """Rows that share no key with a row of a lower level in the same group `within`; rows of one level stay beside each other.

    Unlike `cascade`, a row that goes still outranks later levels. Any key alone is enough, null keys match nothing. The
    lowest level of each key is an aggregation, so a hot key is one row in the join.
    """
    kept = rows
    for i, k in enumerate(keys):
        best = rows.where(F.col(k).isNotNull()).groupBy(*within, k).agg(F.min(level).alias(f"__best_{i}"))
        kept = kept.join(best, [*within, k], "left")
    for i in range(len(keys)):
        kept = kept.where(F.col(f"__best_{i}").isNull() | (F.col(f"__best_{i}") >= F.col(level)))
    return kept.select(*rows.columns)


def after_latest(events: DataFrame, marks: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Events later than the latest mark of their keys; all events of keys without a mark. Null keys are keys."""
    latest = marks.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(ts).alias("__latest"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return events.join(latest, same, "left").where(F.col("__latest").isNull() | (F.col(ts) > F.col("__latest"))).select(*events.columns)


def without_fork_prefix(child: DataFrame, parent: DataFrame, fork: str, order: str, signature: list[str], until: str | None = None) -> DataFrame:
    """Child rows after the longest prefix equal to the parent's, row by row in order.

    child and parent have `fork`, the id of the pair of files; `until` names the child's column with the fork
    time, beyond which nothing counts as replayed (compared with `ts_ms`).
    """
    w = Window.partitionBy(fork).orderBy(order)
    c = child.withColumn("__n", F.row_number().over(w))
    p = parent.select(F.col(fork).alias("__f"), F.row_number().over(w).alias("__m"), *[F.col(s).alias(f"__s_{s}") for s in signature])
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__s_{s}")) for s in signature])
    if until:
        same = same & F.coalesce(F.col("ts_ms") <= F.col(until), F.lit(True))
    joined = c.join(p, (F.col(fork) == F.col("__f")) & (F.col("__n") == F.col("__m")), "left")
    differs = ~(F.col("__m").isNotNull() & F.coalesce(same, F.lit(False)))
    first = F.min(F.when(differs, F.col("__n"))).over(Window.partitionBy(fork))
    return joined.withColumn("__first", first).where(F.col("__n") >= F.col("__first")).select(*child.columns)


def without_replayed(
    events: DataFrame, file: str, parent: str, is_fork: str, order: str, signature: list[str], ts: str, forked: str, burst: str, pause: int = 1000,
) -> DataFrame:
    """events without what forked files repeat of their parent; all columns stay.

    Each row names its file, the parent file (null where it isn't there), whether the file is a fork, and the time of the fork
    (null: any). A fork's rows that equal the parent's row by row from the first on, in order and in `signature`, go; of the
    parent only rows before the first that is later than the fork count. Where already the first row differs, and the file
    begins with a burst (`burst`, its first time), the rows that follow it with at most `pause` ms between them go instead.

    Rows meet by file and ordinal in one equi-join; how far a parent's rows reach is told by their latest time so far. Files
    that aren't forks don't take part. Null times: never later than a fork, and the end of a burst.
    """
    w = Window.partitionBy(file).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.withColumns({"__n": F.row_number().over(w), "__late": F.max(ts).over(so_far)})
    fork = F.coalesce(F.col(is_fork), F.lit(False))
    child = numbered.where(fork)
    known = numbered.select(F.col(file).alias("__f"), F.col("__n").alias("__m"), F.col("__late").alias("__p_late"), *[F.col(s).alias(f"__p_{i}") for i, s in enumerate(signature)])
    joined = child.join(known, (F.col(parent) == F.col("__f")) & (F.col("__n") == F.col("__m")), "left")
    same = reduce(lambda a, b: a & b, [F.col(s).eqNullSafe(F.col(f"__p_{i}")) for i, s in enumerate(signature)])
    same = same & F.col("__m").isNotNull() & F.coalesce(F.col("__p_late") <= F.col(forked), F.lit(True))
    own = Window.partitionBy(file).orderBy("__n")
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(own), F.col(burst))
    near = F.coalesce(gap.between(0, pause), F.lit(False)) & (F.lag(ts).over(own).isNotNull() | (F.col("__n") == 1))
    work = joined.withColumns({"__same": same, "__near": near})
    whole = own.rowsBetween(Window.unboundedPreceding, 0)
    work = work.withColumns({"__repeats": F.min("__same").over(whole), "__bursts": F.min("__near").over(whole), "__starts": F.first("__same").over(whole)})
    gone = F.col("__repeats") | (~F.col("__starts") & F.col(burst).isNotNull() & F.col("__bursts"))
    return events.where(~fork).unionByName(work.where(~gone).select(*events.columns))


def active_path(nodes: DataFrame, tree: str = "source_file", node: str = "id", parent: str = "parent_id", order: str = "seq") -> DataFrame:
    """Rows on the way from each tree's last row to its root.

    A tree with repeated or missing ids, missing parents or a cycle is kept whole, as its active branch can't be told.
    A task walks the links of one tree (a log file) at a time; only links are gathered, no other columns. Ties in
    `order` go by id; an empty table gives an empty one.
    """

    def walk(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["o", "n"], kind="stable", na_position="first")
        up = {n: (None if pd.isna(p) else p) for n, p in zip(links["n"], links["p"], strict=True)}
        sound = len(up) == len(links) and not links["n"].isna().any() and all(p is None or p in up for p in up.values())
        done: set = set()  # nodes known to lead to a root
        for start in up if sound else ():
            path, at = {}, start
            while at is not None and at not in done and at not in path:
                path[at] = True
                at = up[at]
            if at is not None and at not in done:
                sound = False
                break
            done.update(path)
        if not sound:
            return links[["t", "n", "o"]]
        on, at = set(), links["n"].iloc[-1]
        while at is not None:
            on.add(at)
            at = up[at]
        return links.loc[links["n"].isin(on), ["t", "n", "o"]]

    links = nodes.select(F.col(tree).cast("string").alias("t"), F.col(node).cast("string").alias("n"), F.col(parent).cast("string").alias("p"), F.col(order).cast("long").alias("o"))
    on = links.groupBy("t").applyInPandas(walk, "t string, n string, o long").distinct()
    same = F.col(tree).cast("string").eqNullSafe(F.col("t")) & F.col(node).cast("string").eqNullSafe(F.col("n")) & F.col(order).cast("long").eqNullSafe(F.col("o"))
    return nodes.join(on, same, "left_semi")
