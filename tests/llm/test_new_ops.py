"""Source divergence, sharding and spelling variants: DuckDB, brute force, and odd rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from tallymark.llm import divergence, sharding, spelling
from tallymark.llm.common import new_path
from tallymark.llm.queries import ORACLE_SQL, QUERIES
from tallymark.llm.tries import Trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, ids with other texts, and columns whose names clash."""
    texts = [None, "", "  \n ", "Straße STRASSE straße", "naïve naive 中文 é×÷", "colour color colours " * 9, "word " * 4000, "aaaaa aaaab baaaa aaaaaa", "x" * 30_000]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s", "", "s"][i % 4], None) for i, t in enumerate(texts * 2)]
    rows += [rows[5], rows[5], (5, "colour colour colour other text", "en", "s", 1), (None, "colour lonely", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("rank", "shard", "slot", "word", "n", "lang_name", "group", "value", "term"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", ["op11_divergence", "op12_sharding", "op13_spelling"])
def test_against_duckdb(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), ORACLE_SQL[name], connect(sf)) is None


# Operator 11


def brute_audit(rows, least, ranks):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(r["lang"] or "", r["source"] or "", term.findall(lower(r["text"] or ""))) for r in rows]
    df, count = Counter(), Counter()
    for lang, source, terms in docs:
        df.update({(lang, t) for t in terms})
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted((t for (n, t), k in df.items() if n == lang and k >= least), key=str.encode)
        sources, v = {d[1] for d in docs if d[0] == lang}, len(kept)

        def share(counts, v=v):
            return [1 + 10**9 * (c + 5) // (sum(counts) + 5 * v) for c in counts]

        c = {s: [count[lang, s, t] for t in kept] for s in sources}
        p, q = {s: share(c[s]) for s in sources}, share([sum(c[s][i] for s in sources) for i in range(v)])
        for s in sources:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o], strict=True)), o.encode()) for o in sources if o != s))
            out += [(lang, s, "pair", o.decode(), -f, k) for k, (f, o) in enumerate(pairs, 1)]
            terms = sorted((q[i] - p[s][i], t.encode()) for i, t in enumerate(kept) if c[s][i] and p[s][i] > q[i])[:ranks]
            out += [(lang, s, "term", t.decode(), -f, k) for k, (f, t) in enumerate(terms, 1)]
    return sorted(out)


def random_docs(spark, seed, n=120):
    rng = random.Random(seed)
    words = ["red", "Red", "réd", "blue", "blues", "中", "中文", "ﬁn", "x1y", "a_b", "ÀB", "z" * 40, *(f"t{chr(97 + k)}" for k in range(20))]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice([None, "en", "de"]), rng.choice(["s1", "s2", "s3", None, ""]), 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("ranks", [2, 50])
def test_divergence_against_brute_force(spark, odd, ranks):
    for docs, least in ((random_docs(spark, 5), 4), (odd, 2), (odd, 99)):
        got = divergence.audit(docs, least_docs=least, ranks=ranks).select("lang", "source", "part", "item", "value", "rank")
        assert sorted(map(tuple, got.collect())) == brute_audit(docs.collect(), least, ranks)


def test_divergence_in_small_parts(spark, monkeypatch, empty):
    """Many tries, short stretches and sides of two sources give the same rows; shares of huge counts are exact."""
    want = brute_audit(random_docs(spark, 7).collect(), 3, 5)
    monkeypatch.setattr(divergence, "SIDE", 2)
    table = {k: Counter({b"a": 3, b"ab": 1}) for k in [(1, 2), (1, 3)]}
    tries = [Trie.counted({k: (c, c)}) for k, c in table.items()]
    monkeypatch.setattr(divergence, "LEAVES", 5)
    batches = [b for b in _arrow(random_docs(spark, 7))]
    segments = list(divergence._plant(iter(batches)))
    assert sum(s.num_rows for s in segments) > 10
    assert [t for _, t, _, _ in Trie.merged([*tries, Trie.counted({})]).walk(2)] == [b"a", b"ab"]
    got = divergence.audit(random_docs(spark, 7), least_docs=3, ranks=5)
    assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(empty).count() == 0
    big = np.array([0, 7, 10**13], np.int64)
    assert divergence.shares(big, 2 * 10**13, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (2 * 10**13 + 15) for c in big]


def _arrow(df):
    keyed = df.select(F.xxhash64("lang").alias("lang"), F.xxhash64("lang", "source").alias("group"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return keyed.toArrow().to_batches()


def test_trie_segments_round_trip():
    rng = random.Random(3)
    terms = [bytes(rng.choices(b"ab\xc3\xa9", k=rng.randrange(1, 9))) for _ in range(300)]
    counts = {(g % 2, g): (Counter(terms[g::3]), Counter(terms[g::3])) for g in range(3)}
    trie = Trie.counted(counts)
    assert trie.terms == sorted(set(terms))
    back = [Trie.read(s) for _, s in trie.segments(2)]
    assert all(t[:2] == p for p, s in trie.segments(2) for t in Trie.read(s).terms) and sum(len(b.terms) for b in back) == len(trie.terms)
    merged = Trie.merged(back)
    assert merged.terms == trie.terms and all((a == b).all() for a, b in zip(merged.rows, trie.rows, strict=True))


# Operator 12


def brute_shards(rows, shards, seed=sharding.SEED):
    import hashlib

    facts = []
    for r in rows:
        data = (r["text"] or "").encode()
        key = hashlib.md5(":".join([str(seed)] + ([] if r["doc_id"] is None else [str(r["doc_id"])])).encode()).hexdigest()
        facts.append((r["source"] or "", (key, -1 if r["doc_id"] is None else r["doc_id"], zlib.crc32(data), len(data) + 1)))
    by = defaultdict(list)
    for s, f in facts:
        by[s].append(f)
    placed = sorted(((2 * k + 1) / (2 * len(fs)), s, k, f) for s, fs in by.items() for k, f in enumerate(sorted(fs)))
    out, slots = [], Counter()
    for p, (_, s, k, f) in enumerate(placed):
        shard = p * shards // len(placed)
        out.append((f[1], s, f[3], f[2], k, p, shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_sharding_against_brute_force(spark, odd, sf, shards):
    for docs in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = docs.collect()
        got = sharding.interleave(docs, shards).fillna(-1, ["doc_id"]).collect()
        assert sorted(map(tuple, got)) == brute_shards(rows, shards)
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        if len(rows) > 16 * 10:
            for s, n in Counter(r["stratum"] for r in got).items():
                held = Counter(r["shard"] for r in got if r["stratum"] == s)
                assert all(abs(held[k] - n / shards) < 2 for k in range(shards)), s


def test_shards_as_files(spark, odd, empty):
    path = new_path(spark, "shards")
    plain = odd.drop("shard", "slot")
    sharding.write_shards(odd, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    at = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.interleave(odd, 4).collect()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} == at
    assert sharding.interleave(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(odd, 0)


# Operator 13


def brute_words(rows):
    count = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(words):
    found = {w: [x for x in words if x != w and near(w, x)] for w in words}
    form = {}
    for w, xs in found.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n, len(found[w]), form[w] or "", words[form[w]] if form[w] else -1, root(w)) for w, n in words.items())


def plain(df):
    return sorted(map(tuple, df.fillna("", ["form"]).fillna(-1, ["form_n"]).select("word", "n", "n_near", "form", "form_n", "root").collect()))


@pytest.mark.parametrize("block", [2, 64])
def test_spelling_against_brute_force(spark, odd, block):
    rng = random.Random(block)
    stems = ["colour", "center", "naïveté", "aaaaaa", "maximise"]
    words = [w for s in stems for _ in range(60) for w in [list(s)]]
    texts = []
    for w in words:
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = rng.choice(["", "a", "z", "ÿ"])
        texts.append(" ".join(["".join(w)] * rng.choice([1, 3, 4, 7, 30])))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    for df in (docs, odd):
        assert plain(spelling.group_variants(df, block=block)) == brute_forms(brute_words(df.collect()))


def test_near_pairs_in_one_large_block(spark):
    """All words share a beginning and an end, so blocks are subdivided down to the place of the edit; each pair is found once."""
    words = ["".join(["same", *m, "tail"]) for k in (2, 3) for m in itertools.product("abcd", repeat=k)]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [(r["a"], r["b"]) if r["a"] < r["b"] else (r["b"], r["a"]) for r in spelling.near_pairs(table, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p)}


def test_spelling_of_nothing(spark, empty):
    assert spelling.group_variants(empty).count() == 0
    assert spelling.one_edit("abc", "abc") is None and spelling.one_edit("abc", "abcd") == 3 and spelling.one_edit("xbc", "abc") == 0
