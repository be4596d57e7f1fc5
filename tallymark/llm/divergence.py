"""Operator 11, source divergence audit: how far the sources of a language differ in their terms, and by which terms."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pieces, workers_ready
from .tries import Trie

#: Documents of a language that a term stands in at least; what is added to each count; the whole of all shares.
LEAST_DOCS, SMOOTHING, WHOLE = 30, 5, 1_000_000_000
#: Terms listed for a source.
RANKS = 50
#: Counters of a task's trie before it is handed on, and bytes of the prefixes by which tries are merged.
LEAVES, DEPTH = 400_000, 3
#: Terms of a stretch of a merged trie that is compared at a time, and sources compared with each other at a time.
STRETCH, SIDE = 4096, 256

#: Bytes of UTF-8: A-Z as a-z; a-z and all of code points beyond ASCII as they are; what no term holds as spaces.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's documents (lang key, group key, text as bytes) as tries, handed on in segments by prefix."""
    counts: dict[tuple[int, int], tuple[Counter, Counter]] = {}

    def harvest() -> pa.RecordBatch:
        found = list(Trie.counted(counts).segments(DEPTH))
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], ["prefix", "leaves"])

    for batch in batches:
        langs, groups, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for lo, hi in pieces(texts):
            for i, text in zip(range(lo, hi), texts[lo:hi].to_pylist(), strict=True):
                terms = text.translate(_TERMS).split()
                n, docs = counts.setdefault((langs[i], groups[i]), (Counter(), Counter()))
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in counts.values()) > LEAVES:
                yield harvest()
    yield harvest()


_LEAVES = "lang long, stretch string, term binary, groups array<long>, counts array<long>"


def _graft(least_docs: int):
    """Merge segments that come ordered by prefix, one prefix's trie at a time, and list the terms that a language keeps."""

    def graft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows = TaskContext.get().partitionId(), 0, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["lang", "stretch", "term", "groups", "counts"])

        def traverse(parts: list[Trie]) -> None:
            rows.extend((lang, f"{part}-{number}", term, groups, ns) for lang, term, groups, ns in Trie.merged(parts).walk(least_docs))

        prefix, parts = None, []
        for batch in batches:
            for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != prefix:
                    traverse(parts)
                    prefix, parts = p, []
                    if len(rows) >= STRETCH:
                        yield out()
                        rows.clear()
                        number += 1
                parts.append(Trie.read(s))
                if len(parts) > 1 and sum(len(t.terms) for t in parts[1:]) > max(LEAVES, len(parts[0].terms)):
                    parts = [Trie.merged(parts)]
        traverse(parts)
        yield out()

    return graft


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, stretch, term, groups, counts) for rows (lang key, group key, text): the terms in at least least_docs documents of a language.

    Tasks count into tries and hand them on by prefix; tries of a prefix meet in one task, which walks the merged trie
    and lists its terms in the order of their bytes. A task holds its own trie of LEAVES counters or those of a few MB of text
    more, and on the other side the distinct terms of one prefix of DEPTH bytes: segments merge as they come, not all at the end.
    """
    workers_ready(docs.sparkSession)
    planted = docs.select("lang", "group", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(_plant, "prefix binary, leaves binary")
    return planted.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(_graft(least_docs), _LEAVES)


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(WHOLE * (count + 5) / (total + 5 * terms)), exact for counts of any size."""
    whole = total + SMOOTHING * terms
    if whole < 2**63 and int(counts.max(initial=0)) + SMOOTHING < 2**63 // WHOLE:
        return 1 + WHOLE * (counts + SMOOTHING) // whole
    return np.array([1 + WHOLE * (int(c) + SMOOTHING) // whole for c in counts.ravel()], np.int64).reshape(counts.shape)


_COMPARED = "lang long, a long, b long, term binary, value long"


def _compare(ranks: int):
    """Of one stretch of a language's terms: for each two groups the sum of the differences, for each group its leading terms."""

    def compare(key: tuple, terms: pa.Table, totals: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        groups = totals.column("group").to_pylist()
        n, v = totals.column("n").to_pylist(), totals.column("terms")[0].as_py()
        at = {g: i for i, g in enumerate(groups)}
        listed = sorted(zip(terms.column("term").to_pylist(), terms.column("groups").to_pylist(), terms.column("counts").to_pylist(), strict=True)) if terms.num_rows else []
        sums = np.zeros((len(groups), len(groups)), np.int64) if len(groups) <= SIDE else None
        big: dict[tuple[int, int], np.ndarray] = {}
        tops: list[list] = [[] for _ in groups]
        for lo in range(0, len(listed), STRETCH):
            part = listed[lo : lo + STRETCH]
            language = shares(np.array([sum(c) for _, _, c in part], np.int64), sum(n), v)
            columns = []
            for side in range(0, len(groups), SIDE):
                width = min(SIDE, len(groups) - side)
                counts = np.zeros((len(part), width), np.int64)
                for row, (_, gs, cs) in enumerate(part):
                    for g, c in zip(gs, cs, strict=True):
                        if side <= at[g] < side + width:
                            counts[row, at[g] - side] = c
                p = np.stack([shares(counts[:, i], n[side + i], v) for i in range(width)], axis=1)
                columns.append(p)
                lead = np.where(counts > 0, p - language[:, None], 0)
                for i in range(width):
                    # Terms come in order and the sort is stable, so ties stay in the order of their bytes.
                    best = np.argsort(-lead[:, i], kind="stable")[:ranks]
                    mine = [(-int(lead[r, i]), part[r][0]) for r in best if lead[r, i] > 0]
                    tops[side + i] = heapq.nsmallest(ranks, tops[side + i] + mine)
            for x, left in enumerate(columns):
                for y in range(x, len(columns)):
                    acc = sums if sums is not None else big.setdefault((x, y), np.zeros((left.shape[1], columns[y].shape[1]), np.int64))
                    for i in range(left.shape[1]):
                        acc[i] += np.abs(columns[y] - left[:, i : i + 1]).sum(axis=0)
        rows = [(lang, groups[x * SIDE + i], groups[y * SIDE + j], None, int(acc[i, j])) for (x, y), acc in ({(0, 0): sums} if sums is not None else big).items()
                for i in range(acc.shape[0]) for j in range(acc.shape[1]) if x * SIDE + i < y * SIDE + j]
        rows += [(lang, groups[i], None, term, -less) for i, top in enumerate(tops) for less, term in top]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["lang", "a", "b", "term", "value"])

    return compare


def _key(*cols: Column) -> Column:
    return F.xxhash64(*cols)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language differ.

    Part `pair`: for each other source of the language the sum, over the language's kept terms, of the differences of
    their shares. Part `term`: the source's terms whose share is greater than in the whole language, by how much, the
    first `ranks`. A share is 1 + floor(10^9 (count + 5) / (all + 5 terms)); all numbers are whole.

    Null text, language or source count as ''. A text without terms, or a language without kept terms, has groups with
    pairs of value 0. Equal rows each count. An empty table gives an empty one. Other columns play no part. Groups go by
    64-bit hashes of their names inside; should two names share one, the run stops.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang_name"), (source, "source_name"))], F.col(text).alias("text"))
    keyed = named.withColumns({"lang": _key(F.lit("l"), F.col("lang_name")), "group": _key(F.lit("g"), F.col("lang_name"), F.col("source_name"))})
    groups, _ = materialise(keyed.select("lang", "lang_name", "group", "source_name").distinct(), "divergence-groups")
    seen = groups.agg(F.count("*").alias("n"), F.count_distinct("group").alias("g"), F.count_distinct("lang").alias("l"), F.count_distinct("lang_name").alias("k")).first()
    if (seen["n"], seen["l"]) != (seen["g"], seen["k"]):
        raise ValueError("two groups share a hash")
    terms, _ = materialise(kept_terms(keyed, least_docs), "divergence-terms")
    counted = terms.select("lang", F.explode(F.arrays_zip("groups", "counts")).alias("c")).groupBy("lang", F.col("c.groups").alias("group")).agg(F.sum("c.counts").alias("n"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = groups.select("lang", "group").join(counted, ["lang", "group"], "left").join(sizes, "lang").select("lang", "group", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "terms")
    spread = terms.select("lang", "stretch").distinct().join(totals, "lang").select(F.col("lang").alias("of_lang"), F.col("stretch").alias("of_stretch"), "group", "n", "terms")
    compared = terms.groupBy("lang", "stretch").cogroup(spread.groupBy("of_lang", "of_stretch")).applyInArrow(_compare(ranks), _COMPARED)
    compared, _ = materialise(compared, "divergence-compared")
    sums = compared.where("b is not null").groupBy("a", "b").agg(F.sum("value").alias("value"))
    sums = sums.union(sums.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang_name", "source_name", "group")
    left, right = names.select("lang_name", "source_name", F.col("group").alias("a")), names.select("lang_name", F.col("source_name").alias("item"), F.col("group").alias("b"))
    pairs = left.join(right, "lang_name").where("a <> b").join(sums, ["a", "b"], "left")  # its rows are the result's
    pairs = pairs.select("lang_name", "source_name", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    leading = compared.where("b is null").join(left, "a").select("lang_name", "source_name", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    place = F.row_number().over(Window.partitionBy("lang_name", "source_name").orderBy(F.desc("value"), "item"))
    leading = leading.withColumn("rank", place).where(F.col("rank") <= ranks)  # tasks leave out what can't be among them before the shuffle
    ranked = pairs.withColumn("rank", place).unionByName(leading)
    return ranked.select(F.col("lang_name").alias("lang"), F.col("source_name").alias("source"), "part", "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT i, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, (1 + {WHOLE}::HUGEINT * (n + {SMOOTHING}) // (sum(n) OVER w + {SMOOTHING} * count(*) OVER w))::BIGINT AS p FROM cells WINDOW w AS (PARTITION BY lang, source)),
w AS (SELECT lang, term, (1 + {WHOLE}::HUGEINT * (sum(n) + {SMOOTHING}) // (sum(sum(n)) OVER (PARTITION BY lang) + {SMOOTHING} * count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM cells GROUP BY 1, 2),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - w.q AS value FROM p JOIN w ON w.lang = p.lang AND w.term = p.term WHERE p.n > 0 AND p.p > w.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {RANKS}"""
