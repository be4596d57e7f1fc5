"""Operator 13, spelling variant grouping: words one edit apart, found in blocks of forward and reversed sorted dictionaries."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import duck
from .common import drop_path, materialise, pieces, workers_ready

#: Every how many hashes a run loses a code point; code points and occurrences that a word has at least.
EVERY, LENGTH, COUNT = 97, 5, 3
#: Words of a block that are compared with each other; a larger block is subdivided, down to one place of the edit.
BLOCK = 64
#: Words that a task counts before it hands them on.
HELD = 200_000

#: In Latin-1, where a code point is a byte: A-Z as a-z, letters of runs as they are, all else as spaces.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _words_of(doc_id: int | None, text: str) -> Iterator[tuple[bytes, int]]:
    """(word, occurrences) of a text, in Latin-1: each distinct run once, with the code point that its hash takes out left out."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(text.encode("latin-1", "replace").translate(_RUNS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LENGTH:
            yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for lo, hi in pieces(texts):
            for i, text in zip(range(lo, hi), texts[lo:hi].to_pylist(), strict=True):
                for w, n in _words_of(ids[i], text or ""):
                    held[w] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def dictionary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters of whole texts, only A-Z lower-cased, some with a code point deleted by the hash of document and run."""
    workers_ready(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("text is not null")
    counted = slim.mapInArrow(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


# A pair of words one edit apart has a place: the length of their common prefix. A block (kind, m, lo, hi) holds words
# that may form a pair with a place in [lo, hi): kind `s` pairs two words of length m, kind `i` one of length m with one
# of m + 1. All its words share the first lo code points, and the last ones that stand behind every such place. So each
# pair is in exactly one block of the finest cut, and a block that is too large is cut in two by the place.

_KEY = ["kind", "m", "lo", "hi", "head", "tail"]


def _blocked(windows: DataFrame) -> DataFrame:
    """Rows (word, n, kind, m, lo, hi) with what their block shares, `head` and `tail`."""
    behind = F.col("m") - F.col("hi") + F.when(F.col("kind") == "i", 1).otherwise(0)
    return windows.select(
        "word", "n", "kind", "m", "lo", "hi", F.expr("substring(word, 1, lo)").alias("head"),
        F.when(behind > 0, F.right("word", behind)).otherwise("").alias("tail"),
    )


def _halved(blocks: DataFrame) -> DataFrame:
    """Both halves of a block's places: the words by their shared beginning and by their shared end."""
    mid = F.expr("(lo + hi) div 2").cast("int")
    half = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    halves = F.array(half(F.col("lo"), mid), half(mid, F.col("hi")))
    return _blocked(blocks.select("word", "n", "kind", "m", F.explode(halves).alias("w")).select("word", "n", "kind", "m", "w.lo", "w.hi"))


def _entries(words: DataFrame) -> DataFrame:
    """Each word in the forward (shared beginning) and reversed (shared end) dictionary of the three roles it may have."""
    size = F.length("word")
    role = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.alias("m"), F.lit(0).alias("lo"), (m if kind == "s" else m + 1).alias("hi"))
    roles = words.select("word", "n", F.explode(F.array(role("s", size), role("i", size), role("i", size - 1))).alias("r"))
    return _halved(roles.select("word", "n", "r.*"))


def one_edit(a: str, b: str) -> int | None:
    """The length of the common prefix of two words that differ by one inserted, deleted or replaced code point; else None."""
    if len(a) > len(b):
        a, b = b, a
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    rest = a[at + 1 :] if len(a) == len(b) else a[at:]
    return at if len(b) - len(a) < 2 and a != b and rest == b[at + 1 :] else None


def _verified(kind: str, m: int, lo: int, hi: int, words: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    short = [w for w in words if len(w[0]) == m]
    long = words if kind == "s" else [w for w in words if len(w[0]) != m]
    for i, (a, n) in enumerate(short):
        for b, k in short[i + 1 :] if kind == "s" else long:
            at = one_edit(a, b)
            if at is not None and lo <= at < hi:
                yield a, n, b, k


_PAIR = "a string, a_n long, b string, b_n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Range scan: rows come in the order of blocks and words, so a block is a run of rows; only one block is held."""
    key, block, found = None, [], []

    def out() -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64()) * 2, strict=True)], ["a", "a_n", "b", "b_n"])

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if row[:6] != key:
                if len(block) > 1:
                    found.extend(_verified(*key[:4], block))
                    if len(found) > 20_000:
                        yield out()
                        found.clear()
                key, block = row[:6], []
            block.append(row[6:])
    if len(block) > 1:
        found.extend(_verified(*key[:4], block))
    yield out()


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, a_n, b, b_n): each pair of distinct words that differ by one edit, once.

    words has distinct `word` and their `n`. Blocks of more than `block` words are subdivided until they are small or
    their pairs can have one place only; such a block has a word for each code point at most, so none needs a cap.
    Sizes are counted with map-side combining; no task holds more than one small block.
    """
    spark = words.sparkSession
    workers_ready(spark)
    entries, path = materialise(_entries(words), "spelling-blocks")
    pairs = None
    while True:
        large, large_path = materialise(entries.groupBy(*_KEY).agg(F.count("*").alias("__size")).where((F.col("__size") > block) & (F.col("hi") - F.col("lo") > 1)).drop("__size"), "spelling-large")
        some = not large.isEmpty()
        small = entries.join(large, _KEY, "left_anti") if some else entries
        ordered = small.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY, "word")
        found, _ = materialise(ordered.mapInArrow(_scan, _PAIR), "spelling-pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
        if not some:
            break
        finer, finer_path = materialise(_halved(entries.join(large, _KEY, "left_semi")), "spelling-blocks")
        drop_path(spark, path)
        drop_path(spark, large_path)
        entries, path = finer, finer_path
    return pairs


def forms(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n): a word's near words, and the most frequent of them if it is twice as frequent at least (ties: the smallest)."""
    pairs = near_pairs(words, block)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    known = -F.col("best.less") >= 2 * F.col("n")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) with a form: forms followed to the last, by jumps that double in each round.

    A form is twice as frequent as its word, so chains end and are short: their length is a logarithm of the counts.
    """
    spark = links.sparkSession
    at, path = materialise(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("far"))
        jumped = at.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step, step_path = materialise(jumped, "spelling-roots")
        drop_path(spark, path)
        at, path = step.drop("moved"), step_path
        if step.where("moved").isEmpty():
            return at


def group_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the dictionary of docs; root is the word itself where it has no form.

    Null and empty texts have no words. A null doc_id counts as empty in the hash. Rows of one doc_id and equal rows each
    count. An empty table gives an empty one. Other columns, whatever their names, play no part.
    """
    words, _ = materialise(dictionary(docs, doc_id, text), "spelling-words")
    rows, _ = materialise(forms(words, block), "spelling-forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants over the words of all documents."""
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_CUT = "substring(run, 1, (h % length(run))::INTEGER) || substring(run, (h % length(run))::INTEGER + 2)"
ORACLE = f"""WITH RECURSIVE {duck.CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
hashed AS (SELECT run, k, {duck.crc32("doc_id || ':' || run")} AS h FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL) AS d, crc),
w AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % {EVERY} = 0 THEN {_CUT} ELSE run END AS word, k FROM hashed) WHERE length(word) >= {LENGTH} GROUP BY 1 HAVING sum(k) >= {COUNT}),
x AS (SELECT word, n, p, substring(word, 1, p - 1) || substring(word, p + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION SELECT w.word, x.word, x.n FROM w JOIN x ON x.cut = w.word UNION SELECT x.word, w.word, w.n FROM w JOIN x ON x.cut = w.word),
g AS (SELECT a, count(*) AS n_near, max(n) AS most FROM (SELECT DISTINCT * FROM e) GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN (SELECT min(b) FROM e WHERE e.a = w.word AND e.n = most) END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM w LEFT JOIN g ON g.a = w.word),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form, f.form_n::BIGINT AS form_n, r.at AS root FROM f JOIN r ON r.word = f.word JOIN f last ON last.word = r.at AND last.form IS NULL"""
