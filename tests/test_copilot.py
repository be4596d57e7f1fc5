"""Telemetry of requests: kinds of records, their traces, times and counters, and the cut at a session's last snapshot."""

from __future__ import annotations

import json
import random

import pytest

from tallymark.functions.dates import day_start_ms
from tallymark.operators import joins
from tallymark.sources.copilot import copilot

IN, OUT, RESPONSE = "gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens", "gen_ai.response.id"


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def span(name, trace=None, span_id="p", at=1_767_300_000, **attrs):
    named = {k.replace("__", "."): v for k, v in attrs.items()}
    return {"type": "span", "name": name, "spanId": span_id, **({"traceId": trace} if trace else {}), "endTime": [at, 999_000_000], "attributes": {IN: 10, OUT: 2} | named}


def record(body, trace=None, **attrs):
    return {"body": body, **({"spanContext": {"traceId": trace}} if trace else {}), "timestamp": 1_767_300_000_000, "attributes": {IN: 10, OUT: 2} | attrs}


def got(spark, root, *cols, **kw):
    return sorted(tuple(r[c] for c in cols) for r in copilot(spark, str(root), **kw).collect())


def test_kinds_by_precedence_and_context(spark, tmp_path):
    put(
        tmp_path / "otel/a.jsonl",
        span("chat m", "t1", **{"gen_ai.response.model": "m-1m", "session.id": "s1"}), record("GenAI inference: x", "t1"), span("invoke_agent z", "t1"),
        record("GenAI inference: y", "t2"), record("copilot_chat.agent.turn 1", "t2"), {"traceId": "t2", "attributes": {"gen_ai.request.model": "late", RESPONSE: "low"}},
        {"traceId": "t2", "attributes": {"gen_ai.request.model": "later", "github.copilot.interaction_id": "mid"}}, {"traceId": "t2", "attributes": {"github.copilot.interaction_id": "mid2"}},
        record("copilot_chat.agent.turn 2", None, **{RESPONSE: "r"}), record("GenAI inference: gone", "t1", **{RESPONSE: "r"}),  # a record that goes still outranks
        span("invoke_agent only", "t3"), span("chat empty", "t4", **{IN: 0, OUT: 0}), span("other", "t5"), "no json", '{"attributes": [1]}', '{"attributes": "x"}',
    )
    put(tmp_path / "otel/sub/b.jsonl", record("copilot_chat.agent.turn 1", "t1"))  # another file's trace
    rows = got(spark, tmp_path, "session_id", "model", "input_tokens", "output_tokens", "message_count")
    assert rows == [("mid", "late", 10, 2, 1), ("s1", "m", 10, 2, 1), ("t1", "unknown", 10, 2, 1), ("t3", "unknown", 10, 2, 1)]


def test_counters_and_times(spark, tmp_path):
    use = "gen_ai.usage."
    put(
        tmp_path / "otel/a.jsonl",
        span("chat m", "a", **{IN: "100", use + "cache_read.input_tokens": 130, use + "cache_write.input_tokens": 0, use + "cache_creation.input_tokens": 7, use + "total.token_count": 150, use + "reasoning_tokens": 3, OUT: 5}),
        span("chat m", "b", **{IN: 4, OUT: 0, use + "total_tokens": 9}), span("chat m", "c", **{IN: 1.5, OUT: "+3"}), span("chat m", "d", **{IN: -1, OUT: "3.0", use + "total_tokens": 8}),
    )
    cols = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens", "reasoning_tokens")
    rows = got(spark, tmp_path, "session_id", *cols)
    assert rows == [("a", 0, 5, 7, 130, 8, 3), ("b", 4, 5, 0, 0, 0, 0), ("c", 0, 3, 0, 0, 0, 0), ("d", 0, 8, 0, 0, 0, 0)]
    times = [
        ({"endTime": [5, 1_999_999], "startTime": [1, 0]}, 5001), ({"endTime": ["5", "x"], "startTime": [3, 0]}, 3000), ({"_hrTime": [7, 0], "timestamp": 9}, 7000), ({"timestamp": 9}, 9000),
        ({"timestamp": 0}, 0), ({"timestamp": 1_700_000_000_000_000_000}, 1_700_000_000_000), ({"observedTimestamp": "1700000000000000"}, 1_700_000_000_000), ({"timeUnixNano": "1700000000000000000"}, 1_700_000_000_000),
        ({"timestamp": "2026-01-01", "timeUnixNano": 0}, None),
    ]
    f = tmp_path / "t/otel/a.jsonl"
    put(f, *[{"type": "span", "name": "chat m", "traceId": str(i), "attributes": {IN: 1}, **t} for i, (t, _) in enumerate(times)])
    rows = dict(got(spark, tmp_path / "t", "session_id", "ts_ms"))
    assert rows == {str(i): f.stat().st_mtime_ns // 1_000_000 if want is None else want for i, (_, want) in enumerate(times)}


def shut(i, day, n, model="m-1m", **more):
    usage = {"inputTokens": 100 * n, "cacheReadTokens": 40 * n, "outputTokens": n}
    return {"type": "session.shutdown", "id": i, "timestamp": f"2026-01-0{day}T00:00:00Z", "data": {"modelMetrics": {model: {"requests": {"count": n}, "usage": usage}, **more}}}


def test_telemetry_counts_behind_the_last_snapshot(spark, tmp_path):
    put(tmp_path / "session-state/s1/events.jsonl", shut("a", 1, 1), shut("b", 3, 3), shut("z", 4, 0), shut("bad", 4, 9, x=5), shut("bad2", 4, 9) | {"timestamp": "4 January"})
    day = 1_767_225_600
    at = lambda n, sid="s1", model="m": span("chat m", f"t{n}{sid}{model}", at=day + (n - 1) * 86_400, **{"session.id": sid, "gen_ai.response.model": model, OUT: 10 + n})
    put(tmp_path / "otel/a.jsonl", at(1), at(2), at(3), at(4), at(1, "s2"), at(1, "s1", "other"))
    put(tmp_path / "elsewhere.log", at(5))
    out = lambda **kw: [r[0] for r in got(spark, tmp_path, "output_tokens", **kw)]
    # 1 and 2 are the increases of snapshots; the telemetry of day 3 is 0.999 s later than the snapshot of that day
    assert out() == [1, 2, 11, 11, 13, 14]
    assert out(exporter=str(tmp_path / "elsewhere.log")) == [1, 2, 11, 11, 13, 14, 15]
    assert out(since_ms=(day + 86_400) * 1000) == [2, 11, 11, 13, 14]
    assert out(until_ms=(day + 86_400) * 1000) == [1, 11, 11, 11, 12, 13, 14]  # a snapshot that isn't there yet cuts nothing


def test_nothing_at_all(spark, tmp_path):
    assert copilot(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_foremost_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("fg"), rng.choice([None, "x", "y", "z"]), rng.choice([None, *"abcdefgh"]), rng.randrange(4)) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, f string, t string, r string, level int")
    beats = lambda a, b: a[1] == b[1] and a[4] < b[4] and ((a[2] and a[2] == b[2]) or (a[3] and a[3] == b[3]))
    want = {b[0] for b in rows if not any(beats(a, b) for a in rows)}
    assert sorted(r["n"] for r in joins.foremost(df, "level", ["t", "r"], ["f"]).collect()) == sorted(want)
    assert joins.foremost(df.limit(0), "level", ["t", "r"], ["f"]).count() == 0


def test_day_starts():
    hour = 3_600_000
    at = lambda text: int(__import__("datetime").datetime.fromisoformat(text).timestamp() * 1000)
    assert day_start_ms("20260101") == at("2026-01-01T00:00:00+00:00") and day_start_ms("2026-01-01", plus=1) == at("2026-01-02T00:00:00+00:00")
    assert day_start_ms("20260701", "Asia/Kolkata") == at("2026-07-01T00:00:00+05:30")
    assert day_start_ms("20180218", "America/Sao_Paulo") - day_start_ms("20180217", "America/Sao_Paulo") == 25 * hour  # 23:00 to 24:00 comes twice
    assert day_start_ms("20181104", "America/Sao_Paulo") == at("2018-11-04T01:00:00-02:00")  # midnight is skipped
    assert day_start_ms("20251102", "America/Havana") == at("2025-11-02T00:00:00-04:00")  # midnight comes twice
    assert day_start_ms("20111230", "Pacific/Apia") == day_start_ms("20111231", "Pacific/Apia") == at("2011-12-31T00:00:00+14:00")  # a day left out
    for bad in [("20260101", "No/Zone"), ("20261301", "UTC"), ("today", "UTC")]:
        with pytest.raises(ValueError):
            day_start_ms(*bad)
