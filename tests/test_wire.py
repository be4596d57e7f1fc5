"""The wire decoder from bytes written by hand, and the source that reads them."""

from __future__ import annotations

import random
import sqlite3

import pytest

from tallymark.sources import antigravity
from tallymark.sources.registry import SOURCES
from tallymark.sources.wire import Message, WireError, fields, millis


def number(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def message(*parts):
    """Fields (number, value): whole numbers, texts and bytes."""
    out = b""
    for i, v in parts:
        v = v.encode() if isinstance(v, str) else v
        out += number(i << 3) + number(v) if isinstance(v, int) else number(i << 3 | 2) + number(len(v)) + v
    return out


def test_each_wire_type():
    assert list(fields(b"\x08\x96\x01")) == [(1, 150)] and list(fields(b"")) == []
    assert list(fields(b"\x12\x03abc\x19" + b"x" * 8 + b"\x25" + b"y" * 4 + b"\x28\x00")) == [(2, b"abc"), (3, None), (4, None), (5, 0)]
    assert list(fields(b"\x08" + b"\xff" * 9 + b"\x01")) == [(1, 2**64 - 1)]
    broken = [
        b"\x08", b"\x08\x80", b"\x12\x04abc", b"\x19" + b"x" * 7, b"\x25xxx", b"\x00\x01", b"\x0b", b"\x0c", b"\x0e\x00", b"\x0f\x00",
        b"\x08" + b"\xff" * 9 + b"\x02", b"\x08" + b"\x80" * 10 + b"\x00", number(2**32 << 3) + b"\x00",
    ]
    for data in broken:
        with pytest.raises(WireError):
            list(fields(data))


def test_fields_round_trip():
    rng = random.Random(4)
    for _ in range(200):
        parts = [(rng.randrange(1, 2**32 if rng.random() < 0.1 else 40), rng.choice([rng.randrange(2 ** rng.choice([3, 20, 64])), rng.randbytes(rng.randrange(300))])) for _ in range(rng.randrange(6))]
        assert list(fields(message(*parts))) == parts


def test_messages():
    m = Message(message((1, 5), (1, 7), (2, "first"), (2, "last"), (3, " "), (4, b"\xff"), (5, message((1, 9))), (5, message((1, 8))), (6, 2**64 - 1)))
    assert m.count(1) == 7 and m.count(9) == 0 and m.count(6) == 2**63 - 1 and m.text(2) == "last" and m.text(3) is m.text(4) is m.text(9) is None
    assert m.inner(5).count(1) == 9 and [x.count(1) for x in m.every(5)] == [9, 8] and m.inner(9) is None
    assert millis(Message(message((1, 5), (2, 2_999_999_999)))) == 5999 and millis(Message(b"")) is millis(None) is None and millis(Message(message((1, 2**63)))) is None


def usage(**kw):
    at = {"model": 1, "input": 2, "total": 3, "created": 4, "read": 5, "provider": 6, "message": 7, "reasoning": 9, "visible": 10, "response": 11, "remote": 12}
    return message(*[(at[k], v) for k, v in kw.items()])


def stamp(seconds):
    return message((1, seconds))


def generation(use, model=None, at=None, retries=()):
    parts = [(4, use), *[(17, message((2, r))) for r in retries]] + ([(19, model)] if model else []) + ([(9, message((4, stamp(at))))] if at else [])
    return message((1, message(*parts)))


def step(use, model=None, at=None, retries=(), provider=0):
    info = message(*([(12, model)] if model else []), (7, provider))
    return message((9, use), *[(28, message((2, r))) for r in retries], (24, info), *([(8, stamp(at))] if at else []))


def database(path, generations, steps=(), trajectory=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gen_metadata (idx INTEGER, data BLOB)")
    db.executemany("INSERT INTO gen_metadata VALUES (?, ?)", list(enumerate(generations)))
    if steps:
        db.execute("CREATE TABLE steps (idx INTEGER, metadata BLOB)")
        db.executemany("INSERT INTO steps VALUES (?, ?)", list(enumerate(steps)))
    if trajectory:
        db.execute("CREATE TABLE trajectory_metadata_blob (data BLOB)")
        db.execute("INSERT INTO trajectory_metadata_blob VALUES (?)", (message((2, stamp(trajectory))),))
    db.commit()
    db.close()


def test_antigravity(spark, tmp_path):
    database(
        tmp_path / "c/a.db",
        [generation(usage(input=10, total=8, reasoning=3, response="R1"), "Gemini 3.7 Flash (High)", 100), generation(usage(input=4, visible=2, reasoning=5)), generation(usage(model=1072, input=1, provider=3), at=300)],
        [step(usage(input=12, visible=6, response="R1", message="M1", provider=24), retries=[usage(input=7, message="X")]), step(usage(provider=3), at=50), step(None or usage(read=5, message="M1"), at=90)],
        trajectory=77,
    )
    database(tmp_path / "c/b.db", [generation(usage(input=13, message="M1", remote="P"), "claude 3 opus (x)"), generation(usage(input=2, created=1, remote="P"), at=95)])
    database(tmp_path / "c/broken.db", [generation(usage(input=1), at=5), b"\x08"])
    database(tmp_path / "c/null.db", [None, generation(usage(input=1), at=5)])
    (tmp_path / "c/empty.db").write_bytes(b"")
    rows = SOURCES["antigravity"](spark, str(tmp_path)).collect()
    got = sorted((r["session_id"], r["model"], r["input_tokens"], r["output_tokens"], r["cache_creation_tokens"], r["cache_read_tokens"], r["reasoning_tokens"], r["extra_tokens"], r["ts_ms"] // 1000) for r in rows)
    assert got == [
        # R1, M1 and P make one request of five records: the step in a.db first, the earliest of the times that records have themselves.
        ("a", "gemini-3.6-flash-medium", 1, 0, 0, 0, 0, 0, 300), ("a", "gemini-3.7-flash-high", 4, 2, 0, 0, 5, 5, 77), ("a", "gemini-3.7-flash-high", 7, 0, 0, 0, 0, 0, 77), ("a", "gemini-3.7-flash-high", 13, 6, 1, 5, 3, 3, 90),
    ]
    one = next(r for r in rows if r["input_tokens"] == 1)
    assert one["exact_candidates"][:3] == ["gemini-3.6-flash-medium", "google/gemini-3.6-flash-medium", "gemini/gemini-3.6-flash-medium"] and len(one["exact_candidates"]) == 10
    assert one["candidates"] == [] and one["ignores_time"] and one["first_found"] and one["extra_as_output"]


def test_merge_against_brute_force(spark):
    """Chains of shared identities over databases: union-find on the driver gives the same groups and values."""
    rng = random.Random(9)
    events = []
    for k in range(60):
        ids = [f"response:{rng.randrange(40)}" for _ in range(rng.randrange(3))]
        counts = [rng.randrange(20) for _ in range(6)]
        events.append((f"db{k % 3}", 0, k, 0, f"s{k}", rng.choice([antigravity.DEFAULT, "m1", "m2"]), rng.choice([None, 3]), *counts, rng.randrange(1000), rng.choice([0, 1, 3]), ids))
    kinds = "source_file string, kind int, seq long, pos int, session_id string, model string, provider long, input long, output long, created long, read long, reasoning long, total long, ts_ms long, ts_rank int, identities array<string>"
    root = list(range(len(events)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(events):
        for j in range(i):
            if set(a[-1]) & set(events[j][-1]):
                root[top(i)] = top(j)
    want = []
    for r in {top(i) for i in range(len(events))}:
        group = sorted((e for i, e in enumerate(events) if top(i) == r), key=lambda e: e[:4])
        high = [max(e[k] for e in group) for k in range(7, 13)]
        total = max(high[5], high[1] + high[4]) if len(group) > 1 else high[5]
        best = min((-e[14], e[13]) for e in group)[1]
        want.append((group[0][4], next((e[5] for e in group if e[5] != antigravity.DEFAULT), antigravity.DEFAULT), *high[:5], total, best))
    got = antigravity.merged(spark.createDataFrame(events, kinds)).select("session_id", "model", "input", "output", "created", "read", "reasoning", "total", "ts_ms")
    assert sorted(map(tuple, got.collect())) == sorted(want)
