"""Billing blocks on a stream: requests are summed by account, unit and model, then folded by a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import HOUR_MS
from ..operators.blocks import BLOCK_COUNTERS, LENGTH_MS, place_in_units, unit_of, unit_sums
from ..shipping import python_ready

#: The state store that stateful processors need; a session sets it before the stream starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_LONGS = ["start_ms", "first_ms", "last_ms", "n_entries", *BLOCK_COUNTERS]
_BLOCK = [T.StructField(c, T.LongType()) for c in _LONGS] + [
    T.StructField("cost_pico", T.DecimalType(38, 0)), T.StructField("models", T.ArrayType(T.StringType())), T.StructField("reset_ms", T.LongType()),
]


class Blocks(StatefulProcessor):
    """Keeps an account's open block. Units come when they are final, so in order from batch to batch; a timer ends a block that no request follows."""

    def __init__(self, keys: list[str], length: int, unit: int):
        self.keys, self.length, self.unit = keys, length, unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType(_BLOCK))

    def _row(self, key: tuple, block: dict) -> Row:
        return Row(*self.keys, *[f.name for f in _BLOCK])(*key, *[block[f.name] for f in _BLOCK])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.open.get() if self.open.exists() else None
        block = dict(zip([f.name for f in _BLOCK], held, strict=True)) if held is not None else None
        before = block and block["start_ms"]
        for u in sorted(rows, key=lambda r: (r["first_ms"], r["first_seq"] is not None, r["first_seq"] or 0, r["model"] is not None, r["model"] or "")):
            if block and (u["first_ms"] - block["start_ms"] > self.length or u["first_ms"] - block["last_ms"] > self.length):
                start = u["first_ms"] - u["first_ms"] % HOUR_MS
                if start != block["start_ms"]:
                    yield self._row(key, block)
                    block = None
            if block is None:
                block = {"start_ms": u["first_ms"] - u["first_ms"] % HOUR_MS, "first_ms": u["first_ms"], "models": [], **dict.fromkeys(["last_ms", "n_entries", *BLOCK_COUNTERS, "cost_pico", "reset_ms"])}
            for c in ["n_entries", *BLOCK_COUNTERS, "cost_pico"]:
                if u[c] is not None:
                    block[c] = u[c] if block[c] is None else block[c] + u[c]
            block["last_ms"] = u["last_ms"] if block["last_ms"] is None else max(block["last_ms"], u["last_ms"])
            if u["model"] is not None and u["model"] not in block["models"]:
                block["models"] = [*block["models"], u["model"]]
            if block["reset_ms"] is None:
                block["reset_ms"] = u["reset_ms"]
        if before is not None and before != block["start_ms"]:
            self.handle.deleteTimer(self._end(before))
        if before != block["start_ms"]:
            self.handle.registerTimer(self._end(block["start_ms"]))
        self.open.update(tuple(block[f.name] for f in _BLOCK))

    def _end(self, start: int) -> int:
        """When all units that may hold a request of the block are final: one at its very end still belongs to it."""
        return start + self.length + self.unit

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.open.exists():
            block = dict(zip([f.name for f in _BLOCK], self.open.get(), strict=True))
            if self._end(block["start_ms"]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.clear()
                yield self._row(key, block)


def block_stream(stream: DataFrame, keys: list[str], length_ms: int = LENGTH_MS, late: str = "1 day") -> DataFrame:
    """(keys, start_ms, first_ms, last_ms, n_entries, counters, cost_pico, models, reset_ms) of each block once it has ended.

    The rows of `blocks` without gaps, for priced usage (with cost_pico) in append mode. Requests count whatever
    their order while they are less than `late` behind the latest; later ones are dropped, so the state is bounded
    by `late` and one open block an account. Requests without a time are in no block; a null key is a key. Requests are
    summed by account, unit and model by Spark, so Python sees a row for each of these. Needs STATE_STORE in the session.
    """
    python_ready(stream.sparkSession)
    unit = unit_of(length_ms)
    timed = stream.where("ts_ms is not null").withColumns({"event_time": F.timestamp_millis("ts_ms"), "__u": place_in_units(F.col("ts_ms"), unit)})
    timed = timed.withWatermark("event_time", late)
    fine = timed.groupBy(F.window("event_time", f"{unit} milliseconds").alias("w"), *keys, "__u", "model").agg(*unit_sums())
    fine = fine.select(*keys, F.window_time("w").alias("at"), "model", "first_ms", "first_seq", "last_ms", "n_entries", *BLOCK_COUNTERS, "cost_pico", "reset_ms")
    out = T.StructType([*[fine.schema[k] for k in keys], *_BLOCK])
    return fine.groupBy(*keys).transformWithState(Blocks(keys, length_ms, unit), out, "Append", "EventTime")
