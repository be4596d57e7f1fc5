"""Blocks on a stream give the rows of blocks() on the same requests, whatever order they come in."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from tallymark.operators import blocks
from tallymark.streaming.blocks import STATE_STORE, block_stream

H = 3_600_000
SCHEMA = "acct string, ts_ms long, seq long, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost_pico long, reset_ms long"
COLUMNS = ["acct", "start_ms", "first_ms", "last_ms", "n_entries", *blocks.BLOCK_COUNTERS, "cost_pico", "models", "reset_ms"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(11)
    rows = []
    for acct in ("a", "b", None):
        t = 0
        while t < 96 * H:
            t += rng.choice([rng.randrange(0, H), rng.randrange(0, 2 * H), 5 * H, 7 * H + 1])
            t -= t % H if rng.random() < 0.3 else 0
            n = len(rows)
            rows.append((acct, t, n, rng.choice(["m0", "m1", None]), n, 1, 2, 3, 10 * n, rng.choice([None, n])))
    rows += [("exact", 0, 1, "m", 1, 1, 1, 1, 1, None), ("exact", 5 * H, 2, "m", 1, 1, 1, 1, 1, None), ("exact", 5 * H + 1, 3, "m", 1, 1, 1, 1, 1, None)]
    # Files in order of time, but with rows up to 12 hours late; the last row ends all blocks before it.
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 12 * H))
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)] + [[("end", 1000 * H, 0, "m", 0, 0, 0, 0, 0, None)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / f"parts/{i:03d}"))
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "parts"))
        out = block_stream(stream, ["acct"]).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        q = out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    key = lambda r: (str(r["acct"]), r["start_ms"])
    got = sorted(spark.read.parquet(str(tmp_path / "out")).select(*COLUMNS).where(~F.col("acct").eqNullSafe("end")).collect(), key=key)
    batch = blocks.blocks(spark.createDataFrame(rows, SCHEMA), ["acct"], gaps=False).select(*COLUMNS)
    want = sorted(batch.collect(), key=key)
    assert len(want) > 30 and got == want
