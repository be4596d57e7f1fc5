"""Five-word shingle sets of texts as sorted 64-bit hashes, computed for a whole Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import pieces

WIDTH = 5
#: Bytes hashed at a time; bounds the working arrays whatever the length of a text.
PIECE = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_COEF = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_STEP), -1, 2**64))
            up, down = np.full(n, _STEP), np.full(n, inverse)
            up[0] = down[0] = 1
            _POWERS.update(n=n, up=np.cumprod(up, dtype=np.uint64), down=np.cumprod(down, dtype=np.uint64))
    return _POWERS["up"], _POWERS["down"]


def _word_hashes(buf: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place (byte of its start) of each word in buf; words end at white space and at document starts."""
    n = len(buf)
    solid = ~_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = starts_of_docs[starts_of_docs < n]
    first[at] |= solid[at]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    if not len(begin):
        return np.empty(0, np.uint64), begin
    up, down = _powers(n)
    total = np.cumsum(_BYTE[buf] * up[:n], dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    raw = (total[end] - before) * down[begin]
    return mix(raw + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; empty for a null text or one without words."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string())
    count = len(texts)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + count + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    base, stop = (int(offsets[0]), int(offsets[-1])) if count else (0, 0)
    hashes, places = [], []
    with np.errstate(over="ignore"):
        at = base
        while at < stop:
            to = min(stop, at + PIECE)
            if to < stop:  # cut at a document's start or after white space
                k = int(offsets[np.searchsorted(offsets, to, "right") - 1])
                if k > at:
                    to = k
                else:
                    gap = np.flatnonzero(_SPACE[data[at:to]])
                    if len(gap):
                        to = at + int(gap[-1]) + 1
                    else:
                        while to < stop and to not in (k,) and not _SPACE[data[to]] and to < int(offsets[np.searchsorted(offsets, at, "right")]):
                            to += 1
            cut = offsets[(offsets >= at) & (offsets < to)] - at
            h, p = _word_hashes(data[at:to], cut)
            hashes.append(h)
            places.append(p + at)
            at = to
        w = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        bounds = np.searchsorted(place, offsets)  # of document i: words bounds[i]:bounds[i + 1]
        n = len(w)
        full = np.empty(0, np.uint64)
        if n >= WIDTH:
            full = np.zeros(n - WIDTH + 1, np.uint64)
            for k in range(WIDTH):
                full += w[k : n - WIDTH + 1 + k] * _COEF[k]
            full = mix(full)
        out = []
        for i in range(count):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= WIDTH:
                s = np.sort(full[lo : hi - WIDTH + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif hi > lo:
                s = mix((w[lo:hi] * _COEF[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo) * np.uint64(0xA24BAED4963EE407))
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
    return out


def batches_of(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, a few MB of text each, with the shingle sets of their rows."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        for lo, hi in pieces(texts):
            yield batch.slice(lo, hi - lo), sets_of(texts[lo:hi])
