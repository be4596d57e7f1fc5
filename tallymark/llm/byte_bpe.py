"""Operator 6, byte-level BPE: encode texts by a rank file and decode ids, with folds over distinct words.

A text is split by the pattern into words; a word's bytes are merged pair by pair, lowest rank first. Two facts
make that a fold over whole numbers: an id is its rank, and which two ids merge into which id follows from the
rank file alone, so the rank map is a table from pairs to ids. Words are folded many at a time, as arrays. Frequent
words are folded once each, and their ids, a table of bounded size, are broadcast; other distinct words are folded
once an Arrow batch where they stand (they stand in about one text of a task each). So nothing is shuffled but the
words' counts, at any size of the input. Decoding concatenates the ids' pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at_most, drop_path, materialise, pieces, replace_columns, workers_ready

#: Bound of the broadcast table of folded words.
FREQUENT = 400_000
#: Bytes of a word that is folded in an array; a longer one is merged with a heap, as a fold's work grows with the square.
LONGEST = 64
#: Characters of a plan's text that the driver keeps for each query it ran.
PLAN_TEXT = 100_000
#: Bytes of the texts that are encoded together.
PIECE = 4 << 20
#: No merge.
NEVER = (1 << 31) - 1


class Ranks:
    """A rank file (lines `base64 rank`) as a list of byte strings by id, and the ids of single bytes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(a): int(b) for a, b in lines}
        self.pieces = [b""] * (max(self.ids.values()) + 1)
        if len(self.pieces) > 1 << 16:
            raise ValueError("ids of 65536 and more are not supported")
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        self.single = [self.ids[bytes([b])] for b in range(256)]

    def pairs(self) -> list[tuple[int, int, int]]:
        """(left id, right id, id) for every way to cut a piece into two pieces."""
        ids = self.ids
        return [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]

    def merged(self, word: bytes) -> list[int]:
        """Ids of a long word, by a heap of the pairs that can merge: n log n."""
        ids, n = self.ids, len(word)
        part: list[bytes] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ids.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != length:
                continue  # one of the two has merged with another since
            part[i] += part[j]
            part[j] = b""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ids.get(part[a] + part[b])) is not None:
                    heapq.heappush(heap, (r, a, len(part[a]) + len(part[b])))
        return [ids[p] for p in part if p]


def _load(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _let(value: Column, use) -> Column:
    """use(value) with the value evaluated once: an expression is evaluated wherever it is named, a lambda's variable isn't."""
    return F.get(F.transform(F.array(value), use), 0)


class Pairs:
    """Which id two ids merge into, looked up for many pairs at once: an open hash table, filled to a quarter at most."""

    def __init__(self, ranks: Ranks):
        found = np.array(ranks.pairs(), np.int64).reshape(-1, 3)
        bits = max(8, int(len(found) * 4).bit_length())
        self.shift, self.mask = 64 - bits, (1 << bits) - 1
        self.keys, self.ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        keys, ids = found[:, 0] << 16 | found[:, 1], found[:, 2]
        at = self._slots(keys)
        while len(keys):
            _, first = np.unique(at, return_index=True)  # one key a slot
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.ids[at[first]] = keys[first], ids[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ids, at = keys[rest], ids[rest], (at[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of each pair, or NEVER."""
        keys = a.astype(np.int64) << 16 | b
        at = self._slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ids[at], NEVER)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def fold(words: list[str], single: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and the number of ids of each.

    A step applies in each word its lowest merge, the leftmost of equals, and looks up only the two pairs that it
    changes; words without a merge leave.
    """
    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ids = single[np.frombuffer(b"".join(raw), np.uint8)]
    lengths, places, done = np.zeros(len(raw), np.int64), [], []
    names = np.flatnonzero(sizes)  # of the words still at work
    sizes = sizes[names]
    pair = np.full(len(ids), NEVER, np.int32)
    if len(ids):
        pair[:-1] = pairs.merged(ids[:-1], ids[1:])
    while len(names):
        ends = np.cumsum(sizes)
        pair[ends - 1] = NEVER
        low = np.minimum.reduceat(pair, ends - sizes)
        over = low == NEVER
        if over.any():
            gone = np.repeat(over, sizes)
            lengths[names[over]] = sizes[over]
            places.append(names[over])
            done.append(ids[gone])
            ids, pair = ids[~gone], pair[~gone]
            names, sizes, low = names[~over], sizes[~over], low[~over]
            if not len(names):
                break
            ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(names)), sizes)
        hits = np.flatnonzero(pair == low[of])
        at = hits[np.flatnonzero(np.diff(of[hits], prepend=-1))]  # the first of each word
        ids[at] = low
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        at -= np.arange(len(at))  # each word before has lost one
        ids, pair, sizes = ids[keep], pair[keep], sizes - 1
        ends = np.cumsum(sizes)
        left, right = at[at > ends - sizes], at[at < ends - 1]
        pair[at] = NEVER
        pair[right] = pairs.merged(ids[right], ids[right + 1])
        pair[left - 1] = pairs.merged(ids[left - 1], ids[left])
    # Back from the order of leaving to that of the words.
    left_in = np.concatenate(places) if places else np.empty(0, np.int64)
    flat = np.concatenate(done) if done else np.empty(0, ids.dtype)
    n = lengths[left_in]
    starts = np.zeros(len(raw), np.int64)
    starts[left_in] = np.cumsum(n) - n
    return flat[_runs(starts, lengths)], lengths


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run, one run after another."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return np.repeat(starts - (stops - lengths), lengths) + np.arange(total)


def _is_long(word: str) -> bool:
    return len(word) * 4 > LONGEST and len(word.encode()) > LONGEST


def _word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """(word, n) of the words of at most LONGEST bytes over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for batch in batches:
            counts: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                counts.update(find(t or ""))
            kept = {w: n for w, n in counts.items() if not _is_long(w)}
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words with the least count that lets at most `most` of them through; found by a table of counts."""
    level = F.length(F.bin("n"))  # counts by power of two, then within the power that goes over
    by = {r["l"]: r["k"] for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()}
    total, least = 0, 1
    for power in sorted(by, reverse=True):
        if total + by[power] > most:
            least = 1 << power
            break
        total += by[power]
    else:
        return counts
    width = max(1, 2 ** (power - 1) // 256)
    inside = counts.where((level == power) & (F.col("n") < 2**power)).groupBy(F.floor(F.col("n") / F.lit(width)).alias("l")).agg(F.count("*").alias("k")).collect()
    for r in sorted(inside, key=lambda r: -r["l"]):
        if total + r["k"] > most:
            break
        total, least = total + r["k"], r["l"] * width
    return counts.where(F.col("n") >= least)


def _folds(words: DataFrame, shared) -> DataFrame:
    """words with their `ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, pairs, _ = shared.value
        for batch in batches:
            flat, lengths = fold(batch.column(0).to_pylist(), single, pairs)
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], ["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


_INDEX: dict = {}


def _index_of(key, names: pa.Array) -> dict[str, int]:
    """The words' places by text, built once in a Python worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = dict(zip(names.to_pylist(), range(len(names)), strict=True))
    return _INDEX[key]


def _encoder(df: DataFrame, ranks: Ranks, pattern: str, text: str, frequent: int):
    """A function for tasks, from a list of texts to the ids of each; the frequent words of df are folded here."""
    spark: SparkSession = df.sparkSession
    workers_ready(spark)
    at_most(spark, "spark.sql.maxPlanStringLength", PLAN_TEXT)
    rules = spark.sparkContext.broadcast((np.array(ranks.single, np.int32), Pairs(ranks), ranks))  # the fixed vocabulary
    counts, counts_path = materialise(_word_counts(df.select(text), pattern), "words")
    known, known_path = materialise(_folds(_frequent(counts, frequent).select("word"), rules), "word-ids")
    rows = known.toArrow()
    lists = rows.column("ids").combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    flat = lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.uint16) if len(lists) else np.empty(0, np.uint16)
    words = spark.sparkContext.broadcast((rows.column("word").combine_chunks(), np.diff(ends), flat))
    for path in (counts_path, known_path):
        drop_path(spark, path)

    def ids_of(texts: list[str | None]) -> list[np.ndarray]:
        find = regex.compile(pattern).findall
        single, pairs, heap = rules.value
        names, sizes, flat = words.value
        index = _index_of(id(names), names)
        numbers, new, long_words = [], {}, {}  # new words have the numbers after the known ones, long ones negative numbers
        for t in texts:
            found = find(t or "")
            at = np.fromiter(map(index.get, found, repeat(-1)), np.int64, len(found))
            for j in np.flatnonzero(at < 0).tolist():
                w = found[j]
                at[j] = -1 - long_words.setdefault(w, len(long_words)) if _is_long(w) else len(names) + new.setdefault(w, len(new))
            numbers.append(at)
        more, more_sizes = fold(list(new), single, pairs)
        merged = [np.array(heap.merged(w.encode()), np.uint16) for w in reversed(long_words)]  # -1 is the last
        all_ids = np.concatenate([flat, more.astype(np.uint16), *merged])
        all_sizes = np.concatenate([sizes, more_sizes, np.array([len(m) for m in merged], np.int64)])
        starts = np.cumsum(all_sizes) - all_sizes
        return [all_ids[_runs(starts[at], all_sizes[at])].astype(np.int32) for at in numbers]

    return ids_of


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", frequent: int = FREQUENT) -> DataFrame:
    """df with a column of token ids (array<int>), as an encoder without special tokens gives them.

    Null and empty texts have no ids. A column of df with the new one's name is replaced. Rows are encoded
    one by one: ties, repeated rows and empty tables need no rule. Words of more than LONGEST bytes, of any
    length, are merged with a heap; their ids follow the same rule. ranks_path is read on the driver.
    """
    ids_of = _encoder(df, Ranks(ranks_path), pattern, text, frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ids_of(batch.column(batch.num_columns - 1).to_pylist())
            flat = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(ends, flat)], [*batch.schema.names[:-1], "ids"])

    rest = [c for c in df.columns if c.lower() != ids.lower()]
    work = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("__text"))
    schema = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest)) + "ids array<int>"
    return work.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("ids").alias(ids))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes (binary) of its ids: their pieces in order. Null ids give null, no ids no bytes."""
    hexes = _load([p.hex() for p in Ranks(ranks_path).pieces], "array<string>")
    joined = _let(hexes, lambda h: F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.get(h, i)), ""))
    return replace_columns(df, {to: F.unhex(joined)})


def digests(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document, from its ids and from the pieces they decode to.

    No id gives the digests of nothing. Rows are judged one by one, as in encode(). decode() gives the same bytes; here
    they are joined where the ids are, as they leave only as a digest.
    """
    ranks = Ranks(ranks_path)
    work = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__t"))
    ids_of = _encoder(work, ranks, pattern, "__t", frequent)
    shared = docs.sparkSession.sparkContext.broadcast(ranks.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = shared.value.__getitem__
        name_of = [str(i) for i in range(len(shared.value))].__getitem__
        for batch in batches:
            n, ids, decoded = [], [], []
            for lo, hi in pieces(batch.column(1), PIECE):
                for row in ids_of(batch.column(1)[lo:hi].to_pylist()):
                    row = row.tolist()
                    n.append(len(row))
                    ids.append(hashlib.sha256(" ".join(map(name_of, row)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(bytes_of, row))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return work.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
