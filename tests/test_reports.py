"""The report API end to end, and the streaming counterparts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallymark import reports
from tallymark.operators import pricing
from tallymark.plans.bench_view import usage_view
from tallymark.schema import conform
from tallymark.streaming import usage as streaming


def test_reports(spark, sf):
    priced = reports.price(usage_view(spark, sf)).cache()
    o = reports.Options(since="20240105", until="2024-01-10", descending=True)
    daily = reports.periods(priced, "daily", o).collect()
    assert [r["period"] for r in daily] == [f"2024-01-{d:02d}" for d in range(10, 4, -1)]
    for r in daily:
        assert r["total_tokens"] == sum(b["total_tokens"] for b in r["model_breakdowns"])
        costs = [b["cost"] for b in r["model_breakdowns"]]
        assert costs == sorted(costs, reverse=True)
    uni = reports.unified(priced, "monthly").collect()
    assert len(uni) == 1 and uni[0]["total_tokens"] == sum(a["total_tokens"] for a in uni[0]["agent_breakdowns"])
    total = reports.totals(priced)
    assert total.first()["unpriced_models"] == ["unlisted-model"]
    out = json.loads(reports.to_json(reports.periods(priced, "weekly"), total, "weekly", cost=False))
    assert set(out) == {"weekly", "totals"} and "cost" not in out["totals"] and "inputTokens" in out["weekly"][0]
    top = reports.sessions(priced).limit(3).collect()
    assert [r["cost_pico"] for r in top] == sorted((r["cost_pico"] for r in top), reverse=True)
    assert reports.session_detail(priced, top[0]["session_id"]).count() == top[0]["n_entries"] if "source_file" in priced.columns else True
    now = priced.agg(F.max("ts_ms")).first()[0] + 60_000
    live = reports.billing_blocks(priced.withColumn("all", F.lit("x")), now, ["all"], active=True).collect()
    assert len(live) == 1 and live[0]["projected_tokens"] >= live[0]["input_tokens"]
    days = reports.Options(since="2024-01-05", until="20240106", descending=True)
    starts = [r["start_ms"] for r in reports.billing_blocks(priced.withColumn("all", F.lit("x")), now, ["all"], o=days).collect()]
    first = 1_704_412_800_000  # 2024-01-05
    assert starts and starts == sorted(starts, reverse=True) and all(first <= s < first + 2 * 86_400_000 for s in starts)


def test_price_by_candidates_hours_and_codex_rule(spark):
    rates = pricing.rate_table(spark, pricing.rate_rows({"acme/alpha": (2, 10, 4, 1), "beta": (3, 12, 6, 1), "nil": (0, 0, 0, 0)}, {"beta": (6, 24, 12, 2)}))
    rows = [
        (1, "x", "who-knows", ["nowhere", "beta", "acme/alpha"], 10, 0, 0, 0, False, None),  # a provider's name goes first
        (2, "x", "free-of-it", ["acme/alpha", "nil"], 0, 0, 0, 0, False, None),
        (3, "x", "some", ["nil", "beta"], 10, 0, 0, 0, False, None),  # what costs nothing gives way
        (4, "x", "beta", None, 0, 0, 100, 0, False, 40),  # 60 writes at 6, 40 at twice the input rate
        (5, "codex", "beta", None, 150_000, 10, 0, 60_000, False, None),  # a long request is long as a whole
        (6, "x", "beta", None, 150_000, 10, 0, 60_000, False, None),
        (7, "x", "unlisted", ["unlisted"], 5, 0, 0, 0, False, None),
        (8, "x", None, None, 5, 0, 0, 0, False, None),
        (9, "x", None, ["beta"], 5, 0, 0, 0, False, None),
        (10, "x", "vendor-free", ["z:free"], 5, 0, 0, 0, False, None),
    ]
    names = "seq long, agent string, model string, candidates array<string>, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, fast boolean, one_hour long"
    usage = conform(spark.createDataFrame(rows, names).withColumn("ts_ms", F.lit(0).cast("long")))
    got = {r["seq"]: (r["cost_pico"] / 1e6, r["missing_pricing"]) for r in reports.price(usage, rates).collect()}
    assert got == {
        1: (20, False), 2: (0, False), 3: (30, False), 4: (600, False), 5: (150_000 * 6 + 10 * 24 + 60_000 * 2, False),
        6: (150_000 * 3 + 10 * 12 + 60_000, False), 7: (0, True), 8: (0, False), 9: (15, False), 10: (0, False),
    }
    first = reports.price(usage.where("seq = 1"), rates, overrides=["beta"]).first()
    assert first["cost_pico"] == 30_000_000
    assert reports.price(usage.where("false"), rates).count() == 0


def test_last_periods():
    assert reports.since_of_last("daily", 3, "2024-03-01") == "2024-02-28"
    assert reports.since_of_last("weekly", 2, "2024-01-03") == "2023-12-25"
    assert reports.since_of_last("monthly", 3, "2024-02-10") == "2023-12-01"


def test_streaming(spark, sf, tmp_path):
    rows = conform(usage_view(spark, sf).where("seq < 300"))
    rows.write.parquet(str(tmp_path / "in"))
    rows.where("seq < 50").write.mode("append").parquet(str(tmp_path / "in"))
    stream = streaming.once(streaming.usage_stream(spark, str(tmp_path / "in")), ["message_id", "request_id", "ts_ms"], "60 days")
    q = streaming.daily(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["period"], r["agent"], r["model"]): r["n_entries"] for r in spark.table("days").collect()}
    want = {(r["d"], r["agent"], r["model"]): r["n"] for r in rows.groupBy(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("d"), "agent", "model").agg(F.count("*").alias("n")).collect()}
    assert got == want
