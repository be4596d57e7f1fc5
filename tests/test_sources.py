"""Each source reads a small folder of logs written here by hand."""

from __future__ import annotations

import json
import sqlite3

import pytest

from tallymark import reports
from tallymark.sources import codex
from tallymark.sources.registry import SOURCES, read_usage


def put(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in records))


def got(spark, agent, root, *cols):
    rows = SOURCES[agent](spark, str(root)).collect()
    return sorted(tuple(r[c] for c in cols) for r in rows)


COUNTS = ("model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")


def claude_line(mid="m1", rid="r1", out=5, side=False, ts="2026-01-02T03:04:05.000Z", **more):
    usage = {"input_tokens": 10, "output_tokens": out, "cache_creation_input_tokens": 3, "cache_read_input_tokens": 7} | more.pop("usage", {})
    return {"timestamp": ts, "sessionId": "S", "version": "1.2.3", "requestId": rid, "isSidechain": side, "message": {"id": mid, "model": "claude-x", "usage": usage}} | more


def test_claude(spark, tmp_path):
    f = tmp_path / "projects/proj/sess.jsonl"
    put(
        f, claude_line(), claude_line(out=9), claude_line(out=50, side=True), "not json", claude_line(mid="m2", rid="r2", version="x"),
        claude_line(mid="m3", rid="r3", usage={"speed": "fast"}), claude_line(mid="m4", rid="r4", usage={"cache_creation": {"ephemeral_5m_input_tokens": 1, "ephemeral_1h_input_tokens": 2}}),
        '{"timestamp":"2026-01-02T03:04:05Z","requestId":null,"message":{"usage":{"input_tokens":1,"output_tokens":1}}}',
        claude_line(mid="m5", rid="r5", usage={"iterations": [{"type": "advisor_message", "model": "claude-adv", "input_tokens": 2, "output_tokens": 1}]}),
    )
    rows = got(spark, "claude", tmp_path, "message_id", *COUNTS, "fast", "session_id", "project")
    assert rows == [
        ("m1", "claude-x", 10, 9, 3, 7, 0, False, "sess", "proj"), ("m3", "claude-x-fast", 10, 5, 3, 7, 0, True, "sess", "proj"),
        ("m4", "claude-x", 10, 5, 3, 7, 0, False, "sess", "proj"), ("m5", "claude-x", 10, 5, 3, 7, 0, False, "sess", "proj"),
        ("m5:advisor:0", "claude-adv", 2, 1, 0, 0, 0, False, "sess", "proj"),
    ]


def test_claude_nulls_and_replays_without_requests(spark, tmp_path):
    step = {"type": "advisor_message", "model": None, "input_tokens": 2, "output_tokens": 1}
    bare = lambda ts, side, out, mid="m6": {k: v for k, v in {**claude_line(mid=mid, out=out, side=side), "timestamp": ts}.items() if k != "requestId"}
    put(
        tmp_path / "projects/proj/sess.jsonl", claude_line(mid="m1", rid="r1", usage={"iterations": [step]}), claude_line(mid="m2", rid="r2", usage={"iterations": [{**step, "speed": None}]}),
        bare("2026-01-02T03:04:05Z", False, 5), bare("2026-01-02T03:09:05Z", True, 50), bare("2026-01-02T03:04:05Z", True, 6, "m7"), bare("2026-01-02T03:10:05Z", True, 8, "m7"),
        bare("2026-01-02T03:04:05Z", False, 5, "m8"), bare("2026-01-02T03:05:05Z", False, 5, "m8"),
    )
    rows = got(spark, "claude", tmp_path, "message_id", "output_tokens")
    assert rows == [("m1", 5), ("m6", 5), ("m7", 8), ("m8", 5), ("m8", 5)]


def test_claude_side_chains_of_one_time(spark, tmp_path):
    one = lambda rid, side, out, mid="m1", ts="2026-01-02T03:04:05.000Z": claude_line(mid=mid, rid=rid, side=side, out=out, ts=ts)
    bare = lambda *a, **kw: {k: v for k, v in one("", *a, **kw).items() if k != "requestId"}
    put(
        tmp_path / "projects/proj/sess.jsonl",
        one("r1", True, 5), one("r2", True, 8), one("r3", True, 8), one("r4", True, 7, ts="2026-01-02T03:05:05.000Z"),  # two times: two requests
        one("r1", True, 9, "m2"), one("r2", False, 1, "m2"), one("r3", False, 2, "m2"), one("r4", True, 9, "m2"),  # main chains stay, side chains go, in any order
        bare(True, 5, "m3", "2026-01-02T03:00:00.000Z"), one("r9", True, 6, "m3"), bare(True, 4, "m3"),  # joined by those without a request id
    )
    rows = got(spark, "claude", tmp_path, "message_id", "output_tokens", "is_sidechain", "seq")
    assert rows == [("m1", 7, True, 3), ("m1", 8, True, 1), ("m2", 1, False, 5), ("m2", 2, False, 6), ("m3", 6, True, 9)]


def test_claude_forbidden_nulls_at_any_depth(spark, tmp_path):
    keep = [
        claude_line(mid="k1", rid="1", content='a text with "id":null and {"id":null} in it'), claude_line(mid="k2", rid="2", deep=[{"other": None, "ids": None}]),
        claude_line(mid="k3", rid="3", usage={"iterations": [{"type": "x", "model": None}, {"type": "y", "model": None}]}),
        '{"t":"\\u0022id\\u0022:null",' + json.dumps(claude_line(mid="k4", rid="4"))[1:],
    ]
    drop = [
        claude_line(mid="d1", rid="5", deep=[[{"a": [{"id": None}]}]]), '{"\\u0069d":null,' + json.dumps(claude_line(mid="d2", rid="6"))[1:], claude_line(mid="d3", rid="7", usage={"iterations": [{"type": "x", "model": None, "speed": None}]}),
        claude_line(mid="d4", rid="8", usage={"iterations": [{"type": "x", "model": None, "more": [{"model": None}]}]}), claude_line(mid="d5", rid="9", deep={"model": None}, usage={"iterations": []}),
    ]
    put(tmp_path / "projects/proj/sess.jsonl", *[json.loads(json.dumps(x)) if isinstance(x, dict) else x.replace('", "', '","').replace('": ', '":') for x in keep + drop])
    assert [r[0] for r in got(spark, "claude", tmp_path, "message_id")] == ["k1", "k2", "k3", "k4"]


def test_brackets(spark):
    from pyspark.sql import functions as F

    from tallymark.sources.sessions import without_brackets

    names = ["a[b]c", "a[b[c]d]e", "a]b", "a[b", "[x]", "plain", ""]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(without_brackets(F.col("n"))).collect()] == ["ac", "ae", "ab", "a", "", "plain", ""]


def test_journal_frames():
    from tallymark.sources.stores import USAGE_METHOD, journal_records

    def frame(n, extra=b"", size=None):
        body = USAGE_METHOD + b',"params":{"n":%d}%s}' % (n, extra)
        return (len(body) if size is None else size).to_bytes(4, "little") + body

    inner = b',"s":"' + USAGE_METHOD.replace(b'"', b"'") + b'"'
    assert journal_records(b"xx" + frame(1) + b"noise" + frame(2, inner) + frame(3, size=9_999) + frame(4, size=5) + frame(5)) == ['{"n": 1}', '{"n": 2}', '{"n": 5}']
    assert journal_records(USAGE_METHOD + b"}") == journal_records(b"") == [] and journal_records((len(USAGE_METHOD) + 1).to_bytes(4, "little") + USAGE_METHOD + b"}") == []


def test_codex(spark, tmp_path):
    def count(total, last=None, ts="2026-01-02T03:04:05Z"):
        info = {"total_token_usage": {"input_tokens": total, "cached_input_tokens": total // 2, "output_tokens": total // 10}}
        if last:
            info["last_token_usage"] = {"input_tokens": last, "output_tokens": 1}
        return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}

    f = tmp_path / "sessions/2026/a.jsonl"
    put(f, count(100), {"type": "turn_context", "payload": {"model": "gpt-5.5"}}, count(100), count(300, ts="2026-01-02T03:05:05Z"), count(400, 60, "2026-01-02T03:06:05Z"))
    assert got(spark, "codex", tmp_path, *COUNTS, "session_id") == [
        ("gpt-5", 50, 10, 0, 50, 0, "2026/a"), ("gpt-5.5", 60, 1, 0, 0, 0, "2026/a"), ("gpt-5.5", 100, 20, 0, 100, 0, "2026/a"),
    ]


def codex_count(n, ts, last=None, total=None, model=None):
    info = {"total_token_usage": total or {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}}
    if last:
        info["last_token_usage"] = last
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info, **({"model": model} if model else {})}}


def codex_meta(i, parent=None, ts="2026-01-02T04:00:00Z", spawned=False):
    fork = {"source": {"subagent": {"thread_spawn": {"parent_thread_id": parent}}}} if spawned else {"forked_from_id": parent}
    return {"type": "session_meta", "timestamp": ts, "payload": {"id": i, **(fork if parent else {})}}


def test_codex_forks(spark, tmp_path):
    at = lambda m, s=0: f"2026-01-02T03:{m:02d}:{s:02d}Z"
    own = lambda n: {"input_tokens": n, "output_tokens": 1}
    parent = [codex_count(10, at(1)), codex_count(30, at(2)), codex_count(60, at(3)), codex_count(100, "2026-01-02T05:00:00Z")]
    late = lambda n, m: codex_count(n, f"2026-01-02T06:{m:02d}:00Z")
    put(tmp_path / "sessions/a.jsonl", codex_meta("A"), *parent)
    put(tmp_path / "sessions/b.jsonl", codex_meta("B", "A"), late(10, 1), late(30, 2), late(60, 3), late(70, 4))  # repeats three, of which all stand before the fork
    put(tmp_path / "sessions/c.jsonl", codex_meta("C", "A", at(2, 30)), late(10, 11), late(30, 12), late(60, 13))  # the parent's third came after the fork
    put(tmp_path / "sessions/d.jsonl", codex_meta("D", "gone"), codex_count(100, at(20), own(7)), codex_count(200, at(20, 1), own(8)), codex_count(300, at(20, 2), own(9)), codex_count(400, at(20, 4), own(6)))  # a burst, then a pause
    put(tmp_path / "sessions/e.jsonl", codex_meta("E", "A", spawned=True), codex_count(100, at(30), own(11)), codex_count(200, at(30, 5), own(12)))  # nothing repeated, no burst
    put(tmp_path / "sessions/f.jsonl", codex_meta("F", "F"), codex_count(13, at(40)))  # its own parent: none
    put(tmp_path / "archived_sessions/a.jsonl", codex_meta("A"), codex_count(999, at(1)))  # the same file, archived
    rows = got(spark, "codex", tmp_path, "session_id", "input_tokens")
    assert rows == [("a", 10), ("a", 20), ("a", 30), ("a", 40), ("b", 10), ("c", 30), ("d", 6), ("e", 11), ("e", 12), ("f", 13)]


def test_codex_models_tiers_and_headless(spark, tmp_path):
    own = lambda n, **kw: {"input_tokens": n, "output_tokens": 1, **kw}
    count = lambda n, m, model=None, **kw: codex_count(0, f"2026-01-02T03:{m:02d}:00Z", own(n, **kw), total={"input_tokens": n * 7, "output_tokens": 0}, model=model)
    tier = lambda t: {"timestamp": "2026-01-02T03:00:00Z", "type": "event_msg", "payload": {"type": "thread_settings_applied", "thread_settings": {"service_tier": t}}}
    put(
        tmp_path / "sessions/x.jsonl", count(1, 1), count(2, 2), count(3, 3, "gpt-5.5"), tier("priority"), count(4, 4), tier("odd"), count(5, 5), {"type": "turn_context", "payload": {"metadata": {"model": "codex-auto-review"}}},
        count(6, 6, total_tokens=20), count(0, 7, "unused", output_tokens=0),
    )
    put(tmp_path / "sessions/h.jsonl", {"model": "m-h", "timestamp": 1_767_000_000, "usage": {"prompt_tokens": 9, "completion_tokens": 2}}, {"data": {"usage": {"input": 8, "output": 1, "cached_tokens": 3}, "created_at": "2026-01-02T03:04:05Z"}},
        {"result": {"usage": {"input_tokens": 0}}}, {"response": {"usage": {"total_tokens": 4}, "model_name": "codex-auto-review", "createdAt": "2026-08-01T00:00:00Z"}}, "{broken \"usage\":1")
    rows = got(spark, "codex", tmp_path, "session_id", "input_tokens", "model", "is_fallback", "fast", "extra_tokens", "cache_read_tokens")
    assert rows == [
        ("h", 0, "gpt-5.6-luna", True, False, 4, 0), ("h", 5, "m-h", False, False, 0, 3), ("h", 9, "m-h", False, False, 0, 0), ("x", 1, "gpt-5", True, False, 0, 0), ("x", 2, "gpt-5", False, False, 0, 0),
        ("x", 3, "gpt-5.5", False, False, 0, 0), ("x", 4, "gpt-5.5", False, True, 0, 0), ("x", 5, "gpt-5.5", False, False, 0, 0), ("x", 6, "gpt-5.2-codex", True, False, 13, 0),
    ]
    (tmp_path / "config.toml").write_text('model = "x"\nservice_tier = "fast" # for all\n')
    fast = [r["fast"] for r in codex.codex(spark, str(tmp_path)).where("session_id = 'x'").orderBy("seq").collect()]
    assert fast == [True] * 6
    same = [codex_meta("S"), codex_count(10, "2026-01-02T03:00:00Z", own(10), total=own(10))]
    for name in ("s1", "s2"):
        put(tmp_path / f"two/sessions/{name}.jsonl", *same)
    assert codex.codex(spark, str(tmp_path / "two")).count() == 1 and codex.codex(spark, str(tmp_path / "two"), by_session=True, user_aliases={"gpt-5": "mine"}).where("model = 'mine'").count() == 2
    report = reports.by_model(reports.price(codex.codex(spark, str(tmp_path / "two"))), "session").collect()
    assert [(r["period"], r["input_tokens"], [(m["model"], m["is_fallback"]) for m in r["models"]]) for r in report] == [("s1", 10, [("gpt-5", True)])]


def test_qwen(spark, tmp_path):
    line = {"type": "assistant", "sessionId": "s", "timestamp": "2026-01-02T03:04:05Z", "model": "q3", "usageMetadata": {"promptTokenCount": 10, "candidatesTokenCount": 4, "cachedContentTokenCount": 2, "totalTokenCount": 20}}
    put(tmp_path / "projects/p1/chats/c.jsonl", line, line, {**line, "type": "user"})
    assert got(spark, "qwen", tmp_path, *COUNTS, "project") == [("q3", 10, 4, 0, 2, 4, "p1")]


def test_kimi(spark, tmp_path):
    a = {"type": "usage.record", "usageScope": "turn", "time": 1_767_000_000_000, "model": "kimi-code/k2", "usage": {"inputOther": 5, "output": 2, "inputCacheRead": 1}}
    b = {"timestamp": 1767000000.5, "message": {"type": "StatusUpdate", "payload": {"message_id": "x", "token_usage": {"input_other": 3, "output": 1, "total": 6}}}}
    put(tmp_path / "sessions/u/s1/wire.jsonl", a, a, b, {**a, "usageScope": "session"})
    assert got(spark, "kimi", tmp_path, *COUNTS, "ts_ms") == [("k2", 5, 2, 0, 1, 0, 1_767_000_000_000), ("kimi-for-coding", 3, 1, 0, 0, 2, 1_767_000_000_500)]


def test_grok(spark, tmp_path):
    line = {"timestamp": 1_767_000_000, "params": {"sessionId": "s", "_meta": {"eventId": "e"}, "update": {"sessionUpdate": "turn_completed", "usage": {"modelUsage": {
        "b": {"inputTokens": 10, "cachedReadTokens": 4, "outputTokens": 1}, "a-build": {"inputTokens": 2, "outputTokens": 1, "costUsdTicks": 10_000_000_000}}}}}}
    put(tmp_path / "x%20y/s/updates.jsonl", line, line)
    assert got(spark, "grok", tmp_path, *COUNTS, "cost_usd", "project") == [("a-build", 2, 1, 0, 0, 0, 1.0, "x y"), ("b", 6, 1, 0, 4, 0, None, "x y")]


def test_commandcode(spark, tmp_path):
    msg = {"type": "message", "id": "1", "timestamp": "2026-01-02T03:04:05Z", "model": "m-free", "usage": {"inputTokens": 10, "outputTokens": 2, "cacheReadTokens": 3}}
    put(tmp_path / "p/s1.jsonl", {"type": "session", "cwd": "/w"}, msg, msg)
    for job, session in (("j1", "s1"), ("j2", "s9")):
        put(tmp_path / f"jobs/{job}/meta.json", {"model": "m", "startedAt": "2026-01-02T03:04:05Z", "sessionId": session})
        put(tmp_path / f"jobs/{job}/stdout.jsonl", {"type": "event", "event": {"type": "model_request_end", "model": "x", "usage": {"inputTokens": 4, "outputTokens": 1}}}, {"type": "result", "sessionId": session, "usage": {"inputTokens": 99}})
    assert got(spark, "commandcode", tmp_path, *COUNTS, "cost_usd", "session_id", "project") == [("m-free", 7, 2, 0, 3, 0, 0.0, "s1", "/w"), ("x", 4, 1, 0, 0, 0, None, "s9", "Command Code")]


def test_continue(spark, tmp_path):
    put(tmp_path / "tokensGenerated.jsonl", {"timestamp": "2026-01-02T03:04:05Z", "model": "m-latest", "provider": "ollama", "promptTokens": 5, "generatedTokens": 2}, {"timestamp": "bad", "promptTokens": 5})
    assert got(spark, "continue", tmp_path, "session_id", "cost_usd", *COUNTS) == [("2026-01-02", 0.0, "m-latest", 5, 2, 0, 0, 0)]


def test_gemini(spark, tmp_path):
    def msg(i, **tokens):
        return {"type": "gemini", "id": i, "model": "g", "timestamp": "2026-01-02T03:04:05Z", "tokens": tokens}

    put(tmp_path / "a.json", {"sessionId": "s", "messages": [msg("1", input=10, output=2, cached=4, total=12), {"type": "user"}]})
    put(tmp_path / "b.jsonl", msg("1", input=1, output=1), msg("1", input=9, output=1), msg("2", input=3, output=0, thoughts=2))
    assert got(spark, "gemini", tmp_path, "session_id", *COUNTS) == [("b", "g", 3, 0, 0, 0, 2), ("b", "g", 9, 1, 0, 0, 0), ("s", "g", 6, 2, 0, 4, 0)]


def test_amp(spark, tmp_path):
    put(tmp_path / "t1.json", {"id": "T1", "messages": [{"role": "assistant", "messageId": 3, "usage": {"cacheReadInputTokens": 7}}], "usageLedger": {"events": [
        {"timestamp": "2026-01-02T03:04:05Z", "model": "m", "credits": 1.5, "toMessageId": 3, "tokens": {"input": 5, "output": 2}}, {"timestamp": "soon", "model": "m", "tokens": {"input": 5}}]}})
    put(tmp_path / "t2.json", {"id": "T2", "messages": [{"role": "assistant", "timestamp": "2026-01-02T03:04:05Z", "usage": {"model": "n", "inputTokens": 1, "totalTokens": 4}}]})
    assert got(spark, "amp", tmp_path, "session_id", "credits", *COUNTS) == [("T1", 1.5, "m", 5, 2, 0, 7, 0), ("T2", None, "n", 1, 3, 0, 0, 0)]


def test_cline(spark, tmp_path):
    def say(ts, **r):
        return {"type": "say", "say": "api_req_started", "ts": ts, "text": json.dumps(r)}

    put(tmp_path / "task1/ui_messages.json", [say(150, tokensIn=5, tokensOut=1, cost=0.5), say(50, tokensIn=3, tokensOut=1), {"type": "ask"}])
    put(tmp_path / "task1/task_metadata.json", {"model_usage": [{"ts": 100, "model_id": "a", "model_provider_id": "p"}, {"ts": 200, "model_id": "b"}]})
    assert got(spark, "cline", tmp_path, "ts_ms", "cost_usd", *COUNTS) == [(50, None, "a", 3, 1, 0, 0, 0), (150, 0.5, "a", 5, 1, 0, 0, 0)]


def db(path, *statements):
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as con:
        for s in statements:
            con.execute(s)
    con.close()


def test_databases(spark, tmp_path):
    db(tmp_path / "g/sessions.db", "CREATE TABLE sessions (id, model_config_json, provider_name, created_at, total_tokens INT, input_tokens INT, output_tokens INT, accumulated_total_tokens INT, accumulated_input_tokens INT, accumulated_output_tokens INT)",
       """INSERT INTO sessions VALUES ('a', '{"model_name": "claude-x"}', NULL, '2026-01-02 03:04:05', 9, 5, 2, 20, 10, 0), ('b', 'junk', NULL, '2026-01-02', 1, 1, 1, 1, 1, 1)""")
    assert got(spark, "goose", tmp_path / "g", "session_id", "candidates", *COUNTS) == [("a", ["claude-x", "anthropic/claude-x"], "claude-x", 10, 2, 0, 0, 8)]
    db(tmp_path / "h/state.db", "CREATE TABLE sessions (id, model, billing_provider, started_at, message_count, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, estimated_cost_usd, actual_cost_usd)",
       "INSERT INTO sessions VALUES ('a', 'gpt-5', 'OpenAI-Codex', 1767000000, 3, 10, 2, 1, 0, 4, 0.5, NULL), ('a', 'gpt-5', '', 1767000000, 3, 99, 2, 1, 0, 4, 0.5, NULL)")
    assert got(spark, "hermes", tmp_path / "h", "cost_usd", "candidates", *COUNTS) == [(0.5, ["openai/gpt-5", "gpt-5"], "gpt-5", 10, 2, 0, 1, 4)]
    data = json.dumps({"role": "assistant", "id": "m", "modelID": "k", "providerID": "open-ai", "time": {"created": 1767000000}, "cost": 0.1, "tokens": {"input": 4, "output": 1, "reasoning": 2, "cache": {"read": 3, "write": 0}}})
    db(tmp_path / "k/kilo.db", "CREATE TABLE message (id, session_id, data)", f"INSERT INTO message VALUES (1, 's', '{data}'), (2, 's', '{data}'), (3, 's', 'x')")
    assert got(spark, "kilo", tmp_path / "k", "ts_ms", "candidates", *COUNTS) == [(1_767_000_000_000, ["open_ai/k", "k"], "k", 4, 1, 0, 3, 2)]
    db(tmp_path / "z/z.db", "CREATE TABLE session (id, directory)", "CREATE TABLE model_usage (id, session_id, started_at, model_id, status, input_tokens, output_tokens)", "INSERT INTO session VALUES ('s', '/d')",
       "INSERT INTO model_usage VALUES ('1', 's', 1767000000000, 'GLM-5', 'completed', 10, 3), ('2', 'none', 1767000000000, 'glm-5', 'completed', 1, 1), ('3', 's', 5, 'glm-5', 'failed', 1, 1)")
    assert got(spark, "zcode", tmp_path / "z", "project", *COUNTS) == [("/d", "GLM-5", 10, 3, 0, 0, 0), ("ZCode", "glm-5", 1, 1, 0, 0, 0)]
    db(tmp_path / "c/devdata.sqlite", "CREATE TABLE tokens_generated (id, model, provider, tokens_generated, tokens_prompt, timestamp)", "INSERT INTO tokens_generated VALUES (1, 'm', 'openai', 3, 9, '2026-01-02 03:04:05')")
    assert got(spark, "continue-db", tmp_path / "c", "session_id", *COUNTS) == [("2026-01-02", "m", 9, 3, 0, 0, 0)]
    put(tmp_path / "c/tokensGenerated.jsonl", {"timestamp": "2026-01-02T03:04:05Z", "model": "m", "provider": "p", "promptTokens": 9, "generatedTokens": 3})
    assert got(spark, "continue", tmp_path / "c", "session_id", *COUNTS) == [("2026-01-02", "m", 9, 3, 0, 0, 0)]  # one of the two
    both = read_usage(spark, {"goose": str(tmp_path / "g"), "kilo": str(tmp_path / "k")})
    assert sorted(r["agent"] for r in both.collect()) == ["goose", "kilo"]
    with pytest.raises(ValueError):
        read_usage(spark, {"nobody": "x"})


def test_openclaw(spark, tmp_path):
    def msg(i, out, t=1767000000000):
        return {"type": "message", "id": i, "timestamp": t, "message": {"role": "assistant", "usage": {"input": 5, "output": out, "cost": {"total": 0.5}}}}

    put(tmp_path / "s1.jsonl", {"type": "model_change", "modelId": "m1"}, msg("a", 1), msg("a", 1), {"type": "custom", "customType": "model-snapshot", "data": {"modelId": "m2"}}, msg("b", 2))
    assert got(spark, "openclaw", tmp_path, *COUNTS) == [("[openclaw] m1", 5, 1, 0, 0, 0), ("[openclaw] m2", 5, 2, 0, 0, 0)]
    event = json.dumps({"type": "model_change", "modelId": "m1"}), json.dumps(msg("a", 1)), json.dumps(msg("c", 7))
    db(tmp_path / "agent.sqlite", "CREATE TABLE transcript_events (session_id, seq, event_json, created_at)", *[f"INSERT INTO transcript_events VALUES ('s1', {i}, '{e}', 1)" for i, e in enumerate(event)])
    assert got(spark, "openclaw", tmp_path, *COUNTS) == [("[openclaw] m1", 5, 1, 0, 0, 0), ("[openclaw] m1", 5, 7, 0, 0, 0), ("[openclaw] m2", 5, 2, 0, 0, 0)]


def test_droid(spark, tmp_path):
    use = {"inputTokens": 5, "outputTokens": 2, "thinkingTokens": 3}
    put(tmp_path / "a/s.settings.json", {"model": "custom:Claude Opus 4.5 [x]", "providerLockTimestamp": "2026-01-02T03:04:05Z", "tokenUsage": use})
    put(tmp_path / "b/s.settings.json", {"providerLock": "anthropic", "providerLockTimestamp": "2026-01-03T03:04:05Z", "tokenUsage": {**use, "inputTokens": 9}})
    put(tmp_path / "b/s.jsonl", "nothing", 'x Model: Sonnet 4 [y]"')
    assert got(spark, "droid", tmp_path, *COUNTS) == [("sonnet-4", 9, 2, 0, 0, 3)]


def test_copilot(spark, tmp_path):
    def down(i, t, n):
        return {"type": "session.shutdown", "id": i, "timestamp": f"2026-01-0{t}T00:00:00Z", "data": {"modelMetrics": {"m-1m": {"requests": {"count": n}, "usage": {"inputTokens": 100 * n, "cacheReadTokens": 40 * n, "outputTokens": n}}}}}

    put(tmp_path / "state/s1/events.jsonl", down("a", 1, 1), down("b", 2, 3), down("b", 2, 3), down("c", 3, 3))
    assert got(spark, "copilot", tmp_path, *COUNTS, "message_count") == [("m", 60, 1, 0, 40, 0, 1), ("m", 120, 2, 0, 80, 0, 2)]


def test_pi(spark, tmp_path):
    def msg(i, parent, out, t=5):
        return {"type": "message", "id": i, "parentId": parent, "timestamp": f"2026-01-02T03:04:{t:02d}Z", "message": {"role": "assistant", "model": "m", "usage": {"input": 1, "output": out}}}

    head = {"type": "session", "timestamp": "2026-01-02T03:04:30Z"}
    put(tmp_path / "sessions/p/t_one.jsonl", head, msg("a", None, 1), msg("b", "a", 2, 6), msg("c", "a", 3, 7), msg("d", "c", 4, 8))
    put(tmp_path / "sessions/p/t_two.jsonl", {**head, "parentSession": "t_one.jsonl"}, msg("a", None, 1), msg("c", "a", 3, 7), msg("z", "c", 9, 40))
    assert got(spark, "pi", tmp_path, "session_id", "output_tokens", "project") == [("one", 1, "p"), ("one", 3, "p"), ("one", 4, "p"), ("two", 9, "p")]


def test_cyberine(spark, tmp_path):
    put(tmp_path / "r.json", {"runId": "r", "createdAt": "2026-01-02T03:04:05Z", "steps": [{"workerRuns": [{"provider": "deepseek:d1", "costModel": "free", "usage": {"inputTokens": 10, "cacheHitTokens": 4, "outputTokens": 1}}, {"provider": "codex:x", "usage": {"inputTokens": 1}}]}]})
    put(tmp_path / "c.json", {"id": "c", "model": "m", "cacheLedger": [{"at": 1767000000000, "prompt": 9, "hit": 2, "miss": 8, "completion": 3}]})
    put(tmp_path / "t.json", {"id": "t", "model": "m", "updatedAt": 1767000000000, "sessionTokens": {"prompt": 7, "completion": 1}})
    assert got(spark, "cyberine", tmp_path, "session_id", *COUNTS) == [("c", "m", 8, 3, 0, 2, 0), ("r", "d1", 6, 1, 0, 4, 0), ("t", "m", 7, 1, 0, 0, 0)]


def test_codebuff(spark, tmp_path):
    state = {"sessionState": {"mainAgentState": {"messageHistory": [{"role": "assistant", "providerOptions": {"usage": {"outputTokens": 1}}}, {"role": "assistant", "providerOptions": {"codebuff": {"model": "deep", "usage": {"outputTokens": 6}}}}]}}}
    rows = [{"variant": "ai", "id": "1", "metadata": {"usage": {"input_tokens": 4}, "runState": state}, "credits": 2.5}, {"variant": "user"}, {"role": "assistant", "id": "1", "metadata": {"model": "n", "usage": {"promptTokens": 5, "total": 9}}}, {"variant": "ai", "id": "2", "metadata": {"usage": {"input_tokens": 4}, "runState": state}, "credits": 2.5}]
    f = tmp_path / "chan/projects/proj/chats/2026-01-02T03-04-05.000Z/chat-messages.json"
    f.parent.mkdir(parents=True)
    f.write_text(json.dumps(rows))
    chat = "chan/proj/2026-01-02T03-04-05.000Z"
    rows = {(r["session_id"], r["ts_ms"], r["credits"], *[r[c] for c in COUNTS]) for r in SOURCES["codebuff"](spark, str(tmp_path)).collect()}
    assert rows == {(chat, 1767323045000, 2.5, "deep", 4, 6, 0, 0, 0), (chat, 1767323045000, None, "n", 5, 4, 0, 0, 0)}


def test_opencode(spark, tmp_path):
    def data(i, out, cost=0.0):
        return json.dumps({"id": i, "modelID": "m", "providerID": "p", "cost": cost, "time": {"created": 1767000000000}, "tokens": {"input": 5, "output": out, "reasoning": 1, "cache": {"read": 2, "write": 0}}})

    db(tmp_path / "opencode.db", "CREATE TABLE message (id, session_id, data)", "CREATE TABLE session_message (id, session_id, type, data, time_created, seq)", "CREATE TABLE session_v2 (id, fork_session_id, fork_boundary, time_created, cost, tokens_input, tokens_output, tokens_cache_read, tokens_cache_write)",
       f"INSERT INTO message VALUES ('a', 's1', '{data('a', 1)}')", f"INSERT INTO session_message VALUES ('a', 's1', 'assistant', '{data('a', 99)}', 5, 1), ('b', 's1', 'assistant', '{data('b', 2)}', 5, 2), ('c', 's2', 'assistant', '{data('c', 3)}', 5, 2), ('d', 's2', 'assistant', '{data('d', 4)}', 5, 3), ('e', 's3', 'assistant', '{data('e', 6)}', 5, 2)",
       """INSERT INTO session_v2 VALUES ('s2', 's1', '{"type": "through", "messageID": "b"}', 1, 0, 0, 0, 0, 0), ('s3', 's1', '{"type": "before", "messageID": "b"}', 1, 0, 9, 9, 0, 0), ('s4', NULL, NULL, 1767000000000, 0.25, 7, 0, 0, 0)""")
    put(tmp_path / "storage/message/s9/x.json", data("x", 8))
    put(tmp_path / "storage/message/s1/a.json", data("a", 77))
    assert sorted(r["output_tokens"] for r in SOURCES["opencode"](spark, str(tmp_path)).collect()) == [1, 2, 4, 6, 8]
    from tallymark.sources.stores import opencode

    more = {r["session_id"]: (r["input_tokens"], r["cost_usd"]) for r in opencode(spark, str(tmp_path), aggregates=True).collect()}
    assert more["s4"] == (7, 0.25) and more["s3"][0] == 5


def test_muse(spark, tmp_path):
    def frame(**params):
        body = json.dumps({"method": "session/tokenUsage", "params": params}, separators=(",", ":")).encode()
        return len(body).to_bytes(4, "little") + body

    sid = "0" * 8 + "-0000-0000-0000-" + "0" * 12
    folder = tmp_path / "sessions/2026/f1"
    folder.mkdir(parents=True)
    a = frame(turnId="t", modelId="llama", usage={"inputTokens": 10, "outputTokens": 2, "cacheReadTokens": 4}, sourceRange={"first": {"id": sid}})
    b = frame(turnId="t", promptTokens=6, totalTokens=9)
    (folder / "journal-1.bin").write_bytes(b"junk" + a + a + b + b"\x05\x00\x00\x00" + b'{"method":"session/tokenUsage"')
    (folder / "session.jsonl").write_text('{"id":"%s","stream":{"x":1},"sequence":4,"recorded_at":1767000000123456}' % sid)
    put(folder / "snapshot-1.json", {"continuation": {"user_items": {"t": {"recordedAt": "2026-01-02T03:04:05Z"}}, "state": {"branch": {"workspaceRoot": "/w"}}}})
    db(tmp_path / "session-index.db", "CREATE TABLE sessions (session_id, workspace_root, model_id, session_log_path, updated_at_us)", "INSERT INTO sessions VALUES ('f1', NULL, 'idx', NULL, 5)")
    assert got(spark, "muse", tmp_path, *COUNTS, "ts_ms", "project") == [("idx", 6, 3, 0, 0, 0, 1767323045000, "/w"), ("llama", 6, 2, 0, 4, 0, 1767000000123, "/w")]
