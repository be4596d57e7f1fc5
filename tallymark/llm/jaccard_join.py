"""Operator 2, n-gram Jaccard join: documents whose five-word shingle sets have a similarity of 0.75 or more.

A grouped prefix join in two steps. The sieve orders shingles by hash: sets with a similarity of t share at least l
shingles of the first n - ceil(t n) + l of each, so a set of which fewer are known from another set has no partner and
leaves. The join orders the shingles of what is left by their exact number of sets, rare before frequent; partners
share one of the first n - ceil(t n) + 1. Sets with the same prefix and size form one group, and only groups meet;
pairs of groups pass a size filter and a position filter, and then their members are verified on their whole sets.

The result is components, so pairs that are already connected need no second proof. The first round verifies, for each
prefix shingle and class of sizes, the pairs of one group (that with the fewest shingles of its own before this one)
with each other group: as many pairs as postings at most. The second verifies every remaining pair of groups or
members that are not connected yet, so no link between different texts is lost, and a large group of near copies costs
rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import components, drop_path, materialise, workers_ready
from .shingles import batches_of

#: Similarity as a fraction: 100 * shared >= 75 * union.
NUM, DEN = 3, 4
#: The sieve asks for one shared shingle more for each so many shingles of a set.
SIEVE = 10


def _heads(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n, set_key, head): size, 128-bit key of the set, and its first shingles in order of their hash.

    Of rows with equal sets a task gives the head once only, with the first that has a doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch, sets in batches_of(batches, text):
            n, keys, flat, ends, given = [], [], [], [0], []
            named = batch.column(batch.schema.get_field_index(doc_id)).is_valid().to_pylist()
            for s, has_id in zip(sets, named, strict=True):
                k = len(s)
                key = xxhash.xxh3_128_digest(s.tobytes()) if k else None
                n.append(k)
                keys.append(key)
                given.append(bool(k) and has_id and key not in seen)
                length = 0
                if given[-1]:
                    seen.add(key)
                    length = min(k, k - -(-NUM * k // DEN) + k // SIEVE + 1)
                    flat.append(s[:length])
                ends.append(ends[-1] + length)
            values = pa.array(np.concatenate(flat).view(np.int64) if flat else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([not x for x in given], pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(doc_id)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "n", "set_key", "head"]
            )

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n long, set_key binary, head array<long>")


def _sieve(table: DataFrame, known: DataFrame) -> DataFrame:
    """set_key of the sets that have so many head shingles from `known` (s) that they may have a partner.

    The least partner has ceil(t n) shingles, and both share at least as many as the smaller one's head asks for.
    """
    given = table.where("head is not null")
    hits = given.select("doc_id", F.explode("head").alias("s")).join(known.hint("shuffle_hash"), "s").groupBy("doc_id").agg(F.count("*").alias("k"))
    least = F.floor((NUM * F.col("n") + DEN - 1) / DEN)
    return given.select("doc_id", "n", "set_key").join(hits, "doc_id").where(F.col("k") > F.floor(least / SIEVE)).select("set_key").distinct()


def _sets(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """(id, n, items) of the classes in `alive` (id, least, set_key), each once: whole sets, in order of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in batches_of(batches, "text"):
            n = [len(s) for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists], ["least", "n", "set_key", "items"])

    rows = docs.select(F.col("doc_id").alias("least"), "text").join(alive.select("least").distinct(), "least", "left_semi")
    rows = rows.mapInArrow(run, "least long, n long, set_key binary, items array<long>").join(alive, ["least", "set_key"])
    return rows.groupBy("id").agg(F.first("n").alias("n"), F.first("items").alias("items"))


def _entries(sets: DataFrame, often: DataFrame) -> DataFrame:
    """(id, n, own, p, s): the prefix shingles that other sets have, their place p in rare-first order, and how many only this set has."""
    each = sets.select("id", "n", F.explode("items").alias("s")).join(often.hint("shuffle_hash"), "s")
    by_id = Window.partitionBy("id")
    own = F.col("n") - F.count("*").over(by_id)
    ranked = each.select("id", "n", "s", own.alias("own"), F.row_number().over(by_id.orderBy("k", "s")).alias("r"))
    ranked = ranked.select("id", "n", "own", (F.col("own") + F.col("r") - 1).alias("p"), "s")
    return ranked.where((DEN * (F.col("n") - F.col("own")) >= NUM * F.col("n")) & (F.col("p") <= F.floor(F.col("n") / DEN)))


def _groups(entries: DataFrame) -> DataFrame:
    """(id, n, g): sets with the same prefix and size have the same g, the least id. A set with shingles of its own stands alone."""
    mark = (F.bit_xor(F.xxhash64("s")).alias("x"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("y"), F.count("*").alias("k"))
    each = entries.groupBy("id").agg(F.first("n").alias("n"), F.first("own").alias("own"), *mark)
    shared = each.where("own = 0")
    least = shared.groupBy("n", "k", "x", "y").agg(F.min("id").alias("g"))
    return shared.join(least, ["n", "k", "x", "y"]).select("id", "n", "g").union(each.where("own > 0").select("id", "n", F.col("id").alias("g")))


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Size and position filters, if this is the first shingle (places p1, p2 from 0) that the sets share."""
    alike = DEN * F.least(n1, n2) >= NUM * F.greatest(n1, n2)
    most = F.least(n1 - p1, n2 - p2)
    return alike & ((NUM + DEN) * most >= NUM * (n1 + n2))


def _stars(posts: DataFrame) -> DataFrame:
    """Pairs (a, b): of each shingle's groups of about one size, that with the least place and each other, also of the next larger size."""
    here = posts.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / float(np.log(DEN / NUM))).cast("int"))
    lead = here.groupBy("s", "size").agg(F.min(F.struct("p", "n", "g")).alias("lead"))
    near = here.select("s", "g", "n", "p", F.explode(F.array("size", F.col("size") - 1)).alias("size")).join(lead, ["s", "size"])
    near = near.where((F.col("g") != F.col("lead.g")) & _may_link(F.col("n"), F.col("p"), F.col("lead.n"), F.col("lead.p")))
    return near.select(F.least("g", "lead.g").alias("a"), F.greatest("g", "lead.g").alias("b"))


def _remaining(posts: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of members with different roots that share a prefix shingle and pass the filters.

    Of a shingle's list the members of one root, that of the first group, meet the others only and not each other.
    """
    split = placed.groupBy("g").agg(F.min("root").alias("r1"), F.max("root").alias("r2"))
    lists = posts.join(split, "g").groupBy("s").agg(F.min("r1").alias("r1"), F.max("r2").alias("r2"), F.min(F.struct("p", "n", "r1")).getField("r1").alias("main"))
    rest = posts.select("s", "g", "p").join(lists.where("r1 <> r2").select("s", "main"), "s").join(placed, "g").select("s", "p", "n", "id", "root", "main")
    x, y = rest.where("root <> main").alias("x"), rest.drop("main").alias("y")
    once = (F.col("y.root") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))
    apart = (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & once
    cross = x.join(y, apart & _may_link(F.col("x.n"), F.col("x.p"), F.col("y.n"), F.col("y.p"))).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    within = placed.join(split.where("r1 <> r2"), "g").select("g", "id", "root")
    u, v = within.alias("u"), within.alias("v")
    same = u.join(v, (F.col("u.g") == F.col("v.g")) & (F.col("u.id") < F.col("v.id")) & (F.col("u.root") != F.col("v.root")))
    return cross.union(same.select(F.col("u.id").alias("a"), F.col("v.id").alias("b"))).distinct()


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (z.values.to_numpy().view(np.uint64) for z in (x, y))
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                shared = int((v[np.minimum(at, len(v) - 1)] == u).sum()) if len(v) else 0
                ok.append(DEN * shared >= NUM * (len(u) + len(v) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    items = sets.select("id", "items")
    joined = (
        pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        .join(items.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    )
    return joined.mapInArrow(compare, "a long, b long")


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    A-Z are lower-cased and words are `[^\\x20\\x09-\\x0D]+`. Texts of one to four words have one shingle, the
    whole sequence; null and empty texts have none and link with nothing. Rows with equal sets link. Rows
    that repeat a doc_id are rows of the result each; each has its own set and size, and all of them are in one
    component, also those whose texts have nothing in common or no words. A null doc_id links
    with nothing (component null). Shingles are compared by 64-bit hash: within a pair of sets the chance of a
    wrong match is their sizes' product over 2^64. Columns of docs other than these two are not read. An empty
    table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    workers_ready(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        out, path = materialise(df, name)
        scratch.append(path)
        return out

    table = kept(_heads(docs, "text", "doc_id"), "heads")
    # A class of equal sets has a number of its own, as rows of one doc_id may be in several; it is written with the table and so stays.
    classes = table.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"))
    classes = kept(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    # The sieve: shingles of the heads of two different sets or more, then the sets that have enough of them.
    heads = table.where("head is not null").select(F.xxhash64("set_key").alias("k"), F.explode("head").alias("s"))
    known = kept(heads.groupBy("s").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("s"), "known")
    alive = kept(classes.join(_sieve(table, known), "set_key", "left_semi").select("id", "least", "set_key"), "alive")

    # The join over what is left.
    sets = kept(_sets(docs, alive), "sets")
    often = kept(sets.select(F.explode("items").alias("s")).groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "often")
    entries = kept(_entries(sets, often), "entries")
    members = kept(_groups(entries), "members")
    posts = entries.join(members.where("id <> g").select("id"), "id", "left_anti").select("s", F.col("id").alias("g"), "n", "p")

    inside = members.where("id <> g").select(F.col("g").alias("a"), F.col("id").alias("b"))
    pairs = kept(_stars(posts).union(inside).distinct(), "pairs")
    links = kept(_verified(sets, pairs), "links")
    roots = kept(components(links), "roots")
    placed = kept(members.join(roots, members["id"] == roots["node"], "left").select("g", "n", "id", F.coalesce("root", "id").alias("root")), "placed")
    more = kept(_remaining(posts, placed).join(pairs, ["a", "b"], "left_anti"), "more")
    links = links.union(kept(_verified(sets, more), "links"))

    # Rows of one doc_id are one document: its classes belong together.
    filled = table.where("n > 0 and doc_id is not null")
    several = filled.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    several = kept(filled.join(several, "doc_id").where("set_key <> lo").select("set_key", "lo").distinct(), "several")
    if not several.isEmpty():
        number = classes.select("set_key", "id")
        own = several.join(number.withColumnRenamed("id", "a"), "set_key").join(number.select(F.col("set_key").alias("lo"), F.col("id").alias("b")), "lo")
        links = links.union(own.select("a", "b"))

    # A component's name is its least doc_id.
    merged = components(links).join(classes.select(F.col("id").alias("node"), "least"), "node")
    least = merged.groupBy("root").agg(F.min("least").alias("component"))
    merged = merged.join(least, "root").select("node", "component")
    named = classes.join(merged, classes["id"] == merged["node"], "left").select("set_key", F.coalesce("component", "least").alias("component"))
    out = table.select("doc_id", "n", "set_key").join(named, "set_key", "left")
    # A row without words is in the component of its doc_id's other rows.
    bare = out.where("n = 0 and doc_id is not null")
    other = filled.select("doc_id", "set_key").join(bare.select("doc_id").distinct(), "doc_id", "left_semi").join(named, "set_key").groupBy("doc_id").agg(F.min("component").alias("of_others"))
    bare = bare.join(other, "doc_id", "left").select("doc_id", "n", "set_key", F.col("of_others").alias("component"))
    out = out.where("n > 0 or doc_id is null").unionByName(bare)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    out, _ = materialise(out, "components")
    for path in scratch:
        drop_path(spark, path)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by plain sets and all pairs that share a shingle.
ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.node = d.doc_id GROUP BY d.doc_id
"""
