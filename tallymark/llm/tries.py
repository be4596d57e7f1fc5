"""Mergeable radix tries over byte strings whose leaves hold counters of several groups.

A trie is kept as its walk in the order of bytes: each leaf is told by how much of the path to the leaf before it shares
with it (the depth of the node where they part) and by the label of its own edges from there. So strings that share a
beginning share it in memory and on the wire, two tries merge by merging their walks, and a trie is cut at any node.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np

_HEAD = struct.Struct("<II")
_Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _shared(a: bytes, b: bytes) -> int:
    at, end = 0, min(len(a), len(b))
    while at < end and a[at] == b[at]:
        at += 1
    return at


class Trie:
    """Sorted distinct terms, and rows (place of the term, language, group, occurrences, documents) sorted by place and group."""

    def __init__(self, terms: list[bytes], rows: _Rows) -> None:
        self.terms, self.rows = terms, rows

    @classmethod
    def merged(cls, parts: list[Trie]) -> Trie:
        """The trie of all leaves of some tries, counters of equal leaves and groups added up."""
        terms = sorted(set().union(*(p.terms for p in parts)))
        place = dict(zip(terms, range(len(terms)), strict=True))
        moved = [np.fromiter(map(place.__getitem__, p.terms), np.int64, len(p.terms))[p.rows[0]] for p in parts]
        columns = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (moved, *([p.rows[k] for p in parts] for k in range(1, 5)))]
        order = np.lexsort((columns[2], columns[0]))
        at, lang, group, n, docs = (c[order] for c in columns)
        if not len(at):
            return cls(terms, (at, lang, group, n, docs))
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (group[1:] != group[:-1]))))
        return cls(terms, (at[first], lang[first], group[first], np.add.reduceat(n, first), np.add.reduceat(docs, first)))

    @classmethod
    def counted(cls, counts: dict[tuple[int, int], tuple[Counter, Counter]]) -> Trie:
        """The trie of the (occurrences, documents) counted for each (language, group)."""
        parts = []
        for (lang, group), (n, docs) in counts.items():
            size, terms = len(n), list(n)
            full = lambda v, size=size: np.full(size, v, np.int64)
            by_term = np.fromiter(map(docs.__getitem__, terms), np.int64, size)
            parts.append(cls(terms, (np.arange(size), full(lang), full(group), np.fromiter(n.values(), np.int64, size), by_term)))
        return cls.merged(parts)

    def walk(self, least_docs: int) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
        """(language, term, groups, occurrences) of leaves in at least so many documents of the language, in the order of bytes, which for UTF-8 is that of code points."""
        at, lang, group, n, docs = self.rows
        if not len(at):
            return
        order = np.lexsort((group, lang, at))
        at, lang, group, n, docs = (c[order] for c in (at, lang, group, n, docs))
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (lang[1:] != lang[:-1]))))
        enough = np.flatnonzero(np.add.reduceat(docs, first) >= least_docs)
        for lo, hi in zip(first[enough].tolist(), np.append(first, len(at))[enough + 1].tolist(), strict=True):
            yield int(lang[lo]), self.terms[at[lo]], group[lo:hi], n[lo:hi]

    def segments(self, depth: int) -> Iterator[tuple[bytes, bytes]]:
        """(prefix, serialized subtrie) for each beginning of `depth` bytes, in order; shorter terms stand by themselves."""
        terms, (at, *columns) = self.terms, self.rows
        shared = [0, *map(_shared, terms, terms[1:])]
        starts = [i for i, t in enumerate(terms) if not i or shared[i] < depth] + [len(terms)]
        cuts = np.searchsorted(at, starts).tolist()
        depths = np.array(shared, np.uint32)
        sizes = np.fromiter(map(len, terms), np.uint32, len(terms))
        for k, (lo, hi) in enumerate(zip(starts, starts[1:], strict=False)):
            r = slice(cuts[k], cuts[k + 1])
            labels = b"".join([terms[lo], *(t[s:] for t, s in zip(terms[lo + 1 : hi], shared[lo + 1 : hi], strict=True))])
            own = depths[lo:hi].copy()
            own[0] = 0
            yield terms[lo][:depth], b"".join([
                _HEAD.pack(hi - lo, r.stop - r.start), own.tobytes(), sizes[lo:hi].tobytes(), (at[r] - lo).astype(np.uint32).tobytes(), *(c[r].tobytes() for c in columns), labels,
            ])

    @classmethod
    def read(cls, segment: bytes) -> Trie:
        """The subtrie of a serialized segment."""
        leaves, rows = _HEAD.unpack_from(segment)
        at = _HEAD.size

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(segment, kind, count, at)
            at += out.nbytes
            return out

        shared, sizes, place = take(np.uint32, leaves).tolist(), take(np.uint32, leaves).tolist(), take(np.uint32, rows).astype(np.int64)
        columns = [take(np.int64, rows) for _ in range(4)]
        terms, term = [], b""
        for s, size in zip(shared, sizes, strict=True):
            term = term[:s] + segment[at : at + size - s]
            at += size - s
            terms.append(term)
        return cls(terms, (place, *columns))
