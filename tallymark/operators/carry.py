"""Order-dependent operators: deltas of running totals, values carried forward, bursts and as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(value: Column, partition: list[str], order: list[str]) -> Column:
    """The last non-null value up to and with this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def carried_struct(present: Column, value: Column, partition: list[str], order: list[str]) -> Column:
    """As carried(), for values that may themselves be set to null: `present` tells where a row sets one."""
    return carried(F.when(present, F.struct(value.alias("v"))), partition, order)["v"]


def deltas(df: DataFrame, totals: list[str], partition: list[str], order: list[str], suffix: str = "_delta", given: dict[str, str] | None = None) -> DataFrame:
    """df with the increase of each running total over the row before it in the partition.

    A row that repeats all totals is dropped. Where `given` names a column with the log's own increase, that is
    taken; else the difference, never negative. A null total counts as the last one given.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    work = df
    for t in totals:
        work = work.withColumn(f"__p_{t}", F.last(t, ignorenulls=True).over(before))
    same = F.lit(True)
    for t in totals:
        same = same & F.coalesce(F.col(t), F.col(f"__p_{t}")).eqNullSafe(F.col(f"__p_{t}"))
    cols = []
    for t in totals:
        step = F.greatest(F.coalesce(t, f"__p_{t}", F.lit(0)) - F.coalesce(f"__p_{t}", F.lit(0)), F.lit(0).cast("long"))
        own = F.col((given or {}).get(t, t)) if t in (given or {}) else F.lit(None)
        cols.append(F.coalesce(own, step).cast("long").alias(f"{t}{suffix}"))
    first = F.lit(True)
    for t in totals:
        first = first & F.col(f"__p_{t}").isNull()
    return work.where(first | ~same).select(*df.columns, *cols)


def intervals(df: DataFrame, totals: list[str], partition: list[str], ts: str = "ts_ms", since_ms: int | None = None, until_ms: int | None = None, tie: str = "seq") -> DataFrame:
    """Increases between cumulative snapshots in [since_ms, until_ms); the last snapshot before `since_ms` is the baseline. Snapshots of one time go by `tie`."""
    w = Window.partitionBy(*partition).orderBy(ts, *[c for c in (tie,) if c in df.columns])
    cols = [F.greatest(F.col(t) - F.coalesce(F.lag(t).over(w), F.lit(0)), F.lit(0).cast("long")).alias(t) for t in totals]
    out = df.select(*[c for c in df.columns if c not in totals], *cols)
    if since_ms is not None:
        out = out.where(F.col(ts) >= since_ms)
    return out if until_ms is None else out.where(F.col(ts) < until_ms)


def with_fallback_model(df: DataFrame, model: str, partition: list[str], order: list[str], fallback: str) -> DataFrame:
    """df with `model_used` (carried forward, else fallback) and `is_fallback`, set on the first row without a model only."""
    work = df.withColumn("model_used", carried(F.col(model), partition, order))
    none = F.col("model_used").isNull()
    nth = F.sum(none.cast("int")).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return work.select(*df.columns, F.coalesce("model_used", F.lit(fallback)).alias("model_used"), (none & (nth == 1)).alias("is_fallback"))


def bursts(df: DataFrame, partition: list[str], ts: str, order: list[str], most_ms: int = 1000, name: str = "burst") -> DataFrame:
    """df with the number of its run of rows at most `most_ms` apart (1 for the first run of the partition)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    new = F.coalesce((F.col(ts) - F.lag(ts).over(w) > most_ms).cast("long"), F.lit(1).cast("long"))
    return df.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, first_if_none: bool = True) -> DataFrame:
    """left with the right side's `value` in force at its time: the latest at or before it, else the key's first.

    Both sides are merged by key and time in one shuffle; right rows of equal time count in the order of the
    value, the greatest last.
    """
    cols = left.columns
    l_rows = left.select(*keys, F.col(ts), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"))
    r_rows = right.select(*keys, F.col(ts), F.lit(0).alias("__side"), F.col(value).alias("__v"), F.lit(None).cast(l_rows.schema["__row"].dataType).alias("__row"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side", "__v")
    got = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if first_if_none:
        got = F.coalesce(got, F.first("__v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    out = l_rows.unionByName(r_rows).withColumn(value, got).where("__side = 1")
    return out.select(*[F.col(f"__row.`{c}`") for c in cols if c != value], value)
