"""Lines by byte ranges against a plain split, and which files a report from a day on opens."""

from __future__ import annotations

import json
import os
import random

import pytest

from tallymark.sources import files, pruning
from tallymark.sources.registry import read_usage

DAY = 86_400_000


def plain(path, markers=()):
    """Brute force: (seq, line) of a file's text, without the empty rest behind a last line feed."""
    text = path.read_bytes().decode("utf-8", "replace")
    rows = text.split("\n")
    if rows[-1] == "":
        rows.pop()
    return [(n, x) for n, x in enumerate(rows) if not markers or any(m in x for m in markers)]


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Files of many splits: short, long and empty lines, breaks on the border of a range, other line ends, bad bytes."""
    root, rng = tmp_path_factory.mktemp("logs"), random.Random(7)
    mixed = "\n".join("abé"[rng.randrange(3)] * rng.choice([0, 1, 3, 15, 16, 17, 200]) + rng.choice(["", "key", "\r"]) for _ in range(300))
    put = {
        "mixed.log": mixed.encode(), "ended.log": mixed.encode() + b"\n", "empty.log": b"", "feeds.log": b"\n" * 50, "one.log": b"x" * 500, "border.log": (b"y" * 15 + b"\n") * 9,
        "bad.log": b"a\xff\nkey\xfe\n", "sub/a b%20c+d.log": b"key 1\nno\nkey 2", "other.txt": b"key",
    }
    for name, data in put.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    return root


@pytest.mark.parametrize("step", [16, 64, 1 << 20])
@pytest.mark.parametrize("markers", [[], ["key", "bb"]])
def test_lines_of_many_ranges(spark, logs, step, markers):
    want = {(str(p), n, x) for p in logs.rglob("*.log") for n, x in plain(p, markers)}
    rows = files.lines(spark, str(logs), "*.log", markers, step=step).collect()
    assert len(rows) == len(want) and {(r["source_file"], r["seq"], r["value"]) for r in rows} == want
    assert all(r["mtime_ms"] == os.stat(r["source_file"]).st_mtime_ns // 1_000_000 for r in rows)


def test_first_lines(spark, logs):
    rows = files.first_lines(files.listing(spark, str(logs), "*.log")).collect()
    assert {(r["source_file"], r["seq"], r["value"]) for r in rows} == {(str(p), *plain(p)[0]) for p in logs.rglob("*.log") if p.stat().st_size}


def test_a_long_line_belongs_to_its_first_range(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"short\n" + b"z" * 3_000_000 + b"\nlast")
    rows = files.lines(spark, str(tmp_path), "*.log", step=100_000).collect()
    assert sorted((r["seq"], len(r["value"])) for r in rows) == [(0, 5), (1, 3_000_000), (2, 4)]


def test_no_files(spark, tmp_path):
    assert files.lines(spark, str(tmp_path), "*.log").count() == 0
    assert files.first_lines(files.listing(spark, str(tmp_path), "*.log")).count() == 0


def test_only_listed_files_are_opened(spark, logs, tmp_path):
    (tmp_path / "kept.log").write_text("k")
    (tmp_path / "gone.log").write_text("g")
    rows = files.listing(spark, str(tmp_path), "*.log").collect()
    listed = spark.createDataFrame(rows, "source_file string, mtime_ms long, size long")
    (tmp_path / "gone.log").unlink()
    kept = listed.where("source_file like '%kept.log'")
    assert [r["value"] for r in files.lines(spark, str(tmp_path), "*.log", files=kept).collect()] == ["k"]
    with pytest.raises(Exception, match="gone.log"):
        files.lines(spark, str(tmp_path), "*.log", files=listed).collect()


def test_growing_files_are_read_once(spark, tmp_path):
    """Several runs over growing files give the lines of one run over the last state, each once, with their numbers."""
    rng = random.Random(3)
    grow = lambda name, data: (tmp_path / name).open("ab").write(data)
    state, seen = None, []
    for run in range(3):
        for name in ("a.log", "b.log", f"new{run}.log"):
            grow(name, "".join("x" * rng.choice([0, 5, 40]) + f" {run}\n" * rng.choice([1, 2]) for _ in range(9)).encode() + b"open")
        found, after = files.appended(files.listing(spark, str(tmp_path), "*.log"), state, step=32)
        seen += [(r["source_file"], r["seq"], r["value"]) for r in found.collect()]
        state = spark.createDataFrame(after.collect(), after.schema)
    want = {(str(p), n, x) for p in tmp_path.glob("*.log") for n, x in plain(p)[:-1]}  # the last line is still open
    assert len(seen) == len(want) and set(seen) == want
    assert {(r["source_file"], r["n"]) for r in state.collect()} == {(str(p), len(plain(p)) - 1) for p in tmp_path.glob("*.log")}
    found, after = files.appended(files.listing(spark, str(tmp_path), "*.log"), state)
    assert found.count() == 0 and sorted(after.collect()) == sorted(state.collect())
    (tmp_path / "a.log").write_text("anew\n")
    (tmp_path / "b.log").unlink()
    found, after = files.appended(files.listing(spark, str(tmp_path), "*.log"), state)
    assert [(r["seq"], r["value"]) for r in found.collect()] == [(0, "anew")] and after.count() == 5


def test_threshold():
    begins = 1_767_225_600_000  # 2026-01-01 in UTC
    assert pruning.threshold("20260101", begins) == pruning.threshold("2026-01-01", begins) == begins - 38 * 3_600_000
    assert pruning.threshold(None) is None and pruning.threshold("20260101", begins - 15 * 3_600_000) is None


def test_groups_and_parents(spark):
    listed = spark.createDataFrame(
        [("s1/a", 1, 1), ("s1/b", 9, 1), ("s2/a", 2, 1), ("s3/a", None, 1), ("s4/a", 5, 1)], "source_file string, mtime_ms long, size long"
    )
    group = files.F.regexp_extract("source_file", "^[^/]*", 0)
    names = lambda df: sorted(r["source_file"] for r in df.collect())
    assert names(pruning.recent_groups(listed, group, 5)) == ["s1/a", "s1/b", "s3/a", "s4/a"]
    assert len(names(pruning.recent_groups(listed, group, None))) == 5
    lineage = spark.createDataFrame([("s1/b", "s2/a"), ("s2/a", "s1/a"), ("s1/a", None), ("s4/a", None)], "source_file string, parent_file string")
    assert names(pruning.with_parents(listed, lineage, 6)) == ["s1/b", "s2/a"]  # the parent of a late file, not the parent's
    assert names(pruning.with_parents(listed, lineage, None)) == ["s1/a", "s1/b", "s2/a", "s4/a"]
    assert names(pruning.with_parents(listed.limit(0), lineage, 6)) == []


def test_sources_from_a_day_on(spark, tmp_path):
    """Whole sessions of one source, and direct parents of another; what is left unopened is told by its time alone."""
    usage = {"input_tokens": 1, "output_tokens": 1}
    say = lambda i: json.dumps({"timestamp": "2026-01-02T03:04:05Z", "requestId": i, "message": {"id": i, "model": "m", "usage": usage}}, separators=(",", ":"))
    old, new = 1_700_000_000, 1_767_400_000
    for name, text, at in [
        ("c/projects/p/s1.jsonl", say("a"), old), ("c/projects/p/s1/subagents/x.jsonl", say("b"), new), ("c/projects/p/s2.jsonl", say("c"), old),
    ]:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
        os.utime(f, (at, at))
    head = lambda i, parent: json.dumps({"type": "session_meta", "timestamp": "2026-01-02T00:00:00Z", "payload": {"id": i, "forked_from_id": parent}})
    token = lambda n: json.dumps({"type": "event_msg", "timestamp": "2026-01-02T03:04:05.000Z", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n, "output_tokens": 1, "total_tokens": n + 1}}}})
    for name, parent, at, n in [("kid", "mum", new, 10), ("mum", "gran", old, 20), ("gran", None, old, 30), ("else", None, old, 40)]:
        f = tmp_path / f"x/sessions/{name}.jsonl"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(head(name, parent) + "\n" + token(n))
        os.utime(f, (at, at))
    roots = {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "x")}
    got = lambda since: sorted(r["message_id"] or r["session_id"] for r in read_usage(spark, roots, since).collect())
    assert got("20260102") == ["a", "b", "kid", "mum"]
    assert got(None) == got("29990101") == ["a", "b", "c", "else", "gran", "kid", "mum"]
