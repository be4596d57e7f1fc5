"""Byte ranges of files as numbered lines: the task side of the line scan, over Arrow batches of ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs

COUNTED = "source_file string, start long, n long"
LINES = "source_file string, seq long, value string, mtime_ms long"
REACH = "source_file string, mtime_ms long, size long, begin long, before long"
#: Bytes read at a time where a length isn't known beforehand, and bytes of lines in a batch.
CHUNK = 1 << 20
BATCH = 4 << 20

Batches = Iterator[pa.RecordBatch]


def opened(path: str) -> BinaryIO:
    """A file for reading by position: a plain path is local (or mounted), others are addresses of a file system."""
    if "://" not in path:
        return open(path, "rb")
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def breaks(f: BinaryIO, start: int, stop: int) -> int:
    """Lines that begin at start to stop - 1: at the file's first byte and behind each line feed."""
    at = max(start - 1, 0)
    f.seek(at)
    n = int(start == 0)
    while at < stop - 1:
        data = f.read(min(CHUNK, stop - 1 - at))
        if not data:
            break
        n += data.count(b"\n")
        at += len(data)
    return n


def _rest(f: BinaryIO, left: int) -> bytes:
    """What comes up to the next line feed, at most `left` bytes."""
    out = []
    while left > 0:
        data = f.read(min(CHUNK, left))
        if not data:
            break
        end = data.find(b"\n")
        if end >= 0:
            out.append(data[:end])
            break
        out.append(data)
        left -= len(data)
    return b"".join(out)


def begun(f: BinaryIO, start: int, stop: int, size: int) -> list[bytes]:
    """The whole lines that begin at start to stop - 1; what a file gained beyond `size` isn't read."""
    at = max(start - 1, 0)
    f.seek(at)
    data = f.read(stop - at)
    if start > 0:
        _, found, data = data.partition(b"\n")
        if not found:
            return []
    if not data:
        return []
    if data.endswith(b"\n"):
        return data[:-1].split(b"\n")
    return (data + _rest(f, size - stop)).split(b"\n")


def _batch(path: str, mtime: int, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([path] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([mtime] * n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["source_file", "seq", "value", "mtime_ms"])


def counter(step: int) -> Callable[[Batches], Batches]:
    """Lines that begin in each range."""

    def count(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with opened(r["source_file"]) as f:
                    out.append({"source_file": r["source_file"], "start": r["start"], "n": breaks(f, r["start"], min(r["start"] + step, r["size"]))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("source_file", pa.string()), ("start", pa.int64()), ("n", pa.int64())]))

    return count


def reader(step: int, markers: list[str]) -> Callable[[Batches], Batches]:
    """The lines of each range that hold a marker (all without markers), decoded only then."""
    wanted = [m.encode() for m in markers]

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["source_file"]) as f:
                    found = begun(f, r["start"], min(r["start"] + step, r["size"]), r["size"])
                rows, held = [], 0
                for n, line in enumerate(found, r["first"]):
                    if wanted and not any(m in line for m in wanted):
                        continue
                    rows.append((n, line.decode("utf-8", "replace")))
                    held += len(line)
                    if held >= BATCH:
                        yield _batch(r["source_file"], r["mtime_ms"], rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(r["source_file"], r["mtime_ms"], rows)

    return read


def heads(batches: Batches) -> Batches:
    """The first line of each file."""
    for batch in batches:
        for r in batch.to_pylist():
            with opened(r["source_file"]) as f:
                line = _rest(f, r["size"])
            yield _batch(r["source_file"], r["mtime_ms"], [(0, line.decode("utf-8", "replace"))])


def last_end(f: BinaryIO, begin: int, stop: int) -> int:
    """The end of the last whole line in begin to stop - 1, behind its line feed; begin if there is none."""
    while stop > begin:
        at = max(begin, stop - CHUNK)
        f.seek(at)
        found = f.read(stop - at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        stop = at
    return begin


def whole_lines(batches: Batches) -> Batches:
    """Files with their size up to the end of the last whole line."""
    kinds = pa.schema([("source_file", pa.string()), *[(k, pa.int64()) for k in ("mtime_ms", "size", "begin", "before")]])
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            with opened(r["source_file"]) as f:
                end = last_end(f, r["start"], r["size"])
            out.append({"source_file": r["source_file"], "mtime_ms": r["mtime_ms"], "size": end, "begin": r["start"], "before": r["before"]})
        yield pa.RecordBatch.from_pylist(out, kinds)
