"""Operator 4, license scans: patience alignment of license templates with the regions of a text that resemble them.

Words unique to both sides anchor the alignment; the longest increasing subsequence of the anchors stays, and the
gaps between them are aligned in the same way. Coverage is the share of the template's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, workers_ready

#: Least share of a notice's words that must be aligned; of a line, a template of up to so many words, all must be, as
#: the word that names the license is one of few there.
COVERAGE, LINE = 0.75, 16
#: Least share of aligned words from the first to the last of them, of notices and of lines.
DENSITY, LINE_DENSITY = 0.5, 0.8

#: License notices by name.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
        "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
_EDGE = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")


def normal_words(text: str) -> list[str]:
    """Lower-cased words without the marks around them; a word of marks alone is an empty string."""
    return [_EDGE.sub("", w) for w in _WORD.findall(text.lower())]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (i, j) with a[i] == b[j], increasing in both, by patience alignment with common ends taken first."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i >= p or j >= q:
            continue
        in_b = _unique(b, j, q)
        pairs = sorted((x, in_b[w]) for w, x in _unique(a, i, p).items() if w in in_b)
        chain = _increasing(pairs)
        if not chain:
            continue
        last = (i - 1, j - 1)
        for x, y in [*chain, (p, q)]:
            todo.append((last[0] + 1, x, last[1] + 1, y))
            last = (x, y)
        out += chain
    return sorted(out)


def _unique(words: list, lo: int, hi: int) -> dict:
    """Place of each word that stands once in words[lo:hi]."""
    at: dict = {}
    for k in range(lo, hi):
        at[words[k]] = -1 if words[k] in at else k
    return {w: k for w, k in at.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence increasing in the second number, of pairs sorted by the first."""
    tops: list[int] = []
    holders: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before[k] = holders[pile - 1] if pile else -1
        tops[pile : pile + 1] = [y]
        holders[pile : pile + 1] = [k]
    out, k = [], holders[-1] if holders else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def shortest(words: list[str], lo: int, aligned: list[tuple[int, int]], template: list[str]) -> tuple[int, int, list[str]]:
    """(first, stop, matched): the shortest stretch, within that of an alignment of words[lo:], that holds its words in order.

    An alignment may take its first words from another notice further ahead; the stretch then shrinks to the copy itself.
    """
    matched = [template[j] for _, j in aligned]
    first, stop = lo + aligned[0][0], lo + aligned[-1][0] + 1
    best, at = (first, stop), first
    while True:
        k = 0
        while at < stop and k < len(matched):
            k += words[at] == matched[k]
            at += 1
        if k < len(matched):
            return *best, matched
        back = at
        while k:
            back -= 1
            k -= words[back] == matched[k - 1]
        if at - back < best[1] - best[0]:
            best = (back, at)
        at = back + 1


class Scanner:
    """Finds each template's regions in a text: runs of its word pairs, with as many words around as it has."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.words = {name: normal_words(t) for name, t in sorted(templates.items()) if normal_words(t)}
        self.pairs: dict[tuple[str, str], list[str]] = {}
        marks = set()
        for name, ws in self.words.items():
            for pair in set(zip(ws, ws[1:], strict=False)) or {(ws[0], "")}:
                self.pairs.setdefault(pair, []).append(name)
            # Of words that make up more than 1 - coverage of the template, at least one is in any text that holds it.
            left = len(ws) - self._need(ws)
            for w in sorted(set(ws), key=lambda w: (-len(w), w)):
                marks.add(w)
                left -= ws.count(w)
                if left < 0:
                    break
        # A mark that holds another mark is found wherever that one is.
        self.marks = sorted(m for m in marks if not any(o != m and o in m for o in marks))
        # Words that no other template has: a find must hold one of its template's, if there are any.
        owners = Counter(w for ws in self.words.values() for w in set(ws))
        self.telling = {name: {w for w in ws if owners[w] == 1} for name, ws in self.words.items()}

    def _need(self, template: list[str]) -> float:
        """Words of a template that must be aligned."""
        return len(template) if len(template) <= LINE else self.coverage * len(template)

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(name, first word, word after the last, words aligned, words of the template) of each region, by place.

        Of finds that overlap the one with most aligned words stays, those between them taken off, then the shortest.
        """
        low = text.lower()
        if not any(m in low for m in self.marks):
            return []
        words = normal_words(text)
        hits: dict[str, list[int]] = {}
        for k in range(len(words)):
            for name in self.pairs.get((words[k], words[k + 1] if k + 1 < len(words) else ""), self.pairs.get((words[k], ""), ())):
                hits.setdefault(name, []).append(k)
        out = []
        for name, at in hits.items():
            template = self.words[name]
            n = len(template)
            runs = [[at[0], at[0]]]
            for k in at[1:]:
                if k - runs[-1][1] > max(4, n // 2):
                    runs.append([k, k])
                runs[-1][1] = k
            floor = 0
            for r, (first, last) in enumerate(runs):
                stop = runs[r + 1][0] if r + 1 < len(runs) else len(words)
                lo, hi = max(floor, first - n), min(stop, last + n + 1)
                for first_word, end, matched in self._within(words, lo, hi, template):
                    floor = max(floor, end)
                    told = not self.telling[name] or not self.telling[name].isdisjoint(matched)
                    if told and len(matched) >= (LINE_DENSITY if n <= LINE else DENSITY) * (end - first_word):
                        out.append((name, first_word, end, len(matched), n))
        kept: list[tuple[str, int, int, int, int]] = []
        for x in sorted(out, key=lambda x: (x[2] - x[1] - 2 * x[3], x[2] - x[1], x[1], x[0])):
            place = bisect_left(kept, x[1], key=lambda k: k[1])
            if (place == 0 or kept[place - 1][2] <= x[1]) and (place == len(kept) or kept[place][1] >= x[2]):
                kept.insert(place, x)
        return kept

    def _within(self, words: list[str], lo: int, hi: int, template: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        """Aligned stretches of words[lo:hi], with the words aligned; what lies before and after one may hold further copies."""
        n, need = len(template), self._need(template)
        todo = [(lo, hi)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < need:
                continue
            at = align(words[lo:hi], template)
            if len(at) >= need:
                first, last, matched = shortest(words, lo, at, template)
                yield first, last, matched
                todo += [(lo, first), (last, hi)]
            elif hi - lo > n:  # copies take the uniqueness from each other's words: look at overlapping parts
                last = lo
                for first, stop, matched in self._parts(words, lo, hi, template):
                    yield first, stop, matched
                    todo.append((last, first))
                    last = stop
                if last > lo:
                    todo.append((last, hi))

    def _parts(self, words: list[str], lo: int, hi: int, template: list[str]) -> list[tuple[int, int, list[str]]]:
        """Aligned stretches of parts of words[lo:hi], by place; where they overlap most words win, then the shortest.

        A part longer than the template by a half holds a copy whose middle stands in it once, so each width
        takes steps by which a copy that fits with a step to spare lies whole in one part.
        """
        n, need, times = len(template), self._need(template), Counter(template)
        found = set()
        for width, step in ((n + n // 4, n // 8), (n + n // 2, n // 4), (2 * n, n // 2), (3 * n, n)):
            for k in range(lo, max(lo, hi - width) + max(step, 1), max(step, 1)):
                part = words[k : min(k + width, hi)]
                if sum(times[w] for w in set(part) if w in times) < need:
                    continue
                at = align(part, template)
                if len(at) >= need:
                    first, stop, matched = shortest(words, k, at, template)
                    found.add((len(at), first, stop, tuple(matched)))
        out: list[tuple[int, int, list[str]]] = []
        for _, first, stop, matched in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1:])):
            place = bisect_left(out, (first, stop), key=lambda x: x[:2])
            if (place == 0 or out[place - 1][1] <= first) and (place == len(out) or out[place][0] >= stop):
                out.insert(place, (first, stop, list(matched)))
        return out


def license_scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row of df's other columns for each license found, with license, first_word, n_words, n_aligned and coverage.

    first_word counts from 0 over words `[^\\x20\\x09-\\x0D]+`; n_words: from the first to the last aligned word;
    coverage: n_aligned over the template's words, at least `coverage`, and 1 of a line of up to LINE words. At least
    DENSITY (of lines LINE_DENSITY) of the words from first to last are aligned, and one of the aligned is a word that no
    other template has. The stretch is the shortest that holds the aligned words. Words are compared in lower case without
    the marks around them. A template of two or more words is sought where two of its neighbouring words stand
    together. Of finds that overlap only
    that with most aligned words, those between them taken off, is told. Null and empty texts hold none. Columns of df
    with the new names are replaced; repeated rows are scanned each; an empty table gives an empty table.
    Templates are a short list of parameters. Whole texts are scanned, and no row is moved.
    """
    spark: SparkSession = df.sparkSession
    workers_ready(spark)
    new = ["license", "first_word", "n_words", "n_aligned", "coverage"]
    rest = [c for c in df.columns if c != text and c.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in pieces(texts):
                rows, found = [], []
                for i, t in enumerate(texts[lo:hi].to_pylist(), lo):
                    for name, first, last, aligned, n in scanner.scan(t) if t else ():
                        rows.append(i)
                        found.append((name, first, last - first, aligned, aligned / n))
                if rows:
                    values = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns[:-1], *values], [*batch.schema.names[:-1], *new])

    work = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("__text"))
    schema = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest)) + "license string, first_word long, n_words long, n_aligned long, coverage double"
    return work.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
