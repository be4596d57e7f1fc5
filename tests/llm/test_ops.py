"""The corpus operators against brute force, round trips and planted cases, with nulls, empty and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe, decontaminate, jaccard_join, language_id, license_scan, line_dedup, quality, token_counts, token_files, url_filter
from tallymark.llm.common import components, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows, odd characters, a long word and a long text."""
    texts = [None, "", "   \n\t ", "one", "one", "One TWO three", "é́ İ 中文 — ñ", "x" * 5000, "word " * 3000, "<|endoftext|> don't \x1c\x85 12", "123 456"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "lonely text without id", None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# Operator 1


def expected_files(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out, start = {}, 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        out[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def written(spark, df):
    path = new_path(spark, "t")
    token_files.write_token_files(df, path, P.path("word_bpe_49k.json"), 1)
    return path, token_files.read_token_files(spark, path)


def test_token_files(spark, docs):
    path, back = written(spark, docs)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["c"]) for r in back.withColumn("c", F.crc32("ids")).collect()}
    want = expected_files(docs.collect())
    assert got == want
    some = token_files.read_token_files(spark, path, [7, 150]).withColumn("c", F.crc32("ids")).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["c"]) for r in some} == {k: want[k] for k in (7, 150)}


def test_token_files_odd(spark, odd, empty):
    rows = [r for r in odd.collect() if r["doc_id"] is not None]
    _, back = written(spark, odd.withColumn("START", F.lit(1)))
    got = back.withColumn("c", F.crc32("ids")).collect()
    assert len(got) == odd.count()
    want = expected_files(rows)
    assert {(r["doc_id"], r["n_tokens"], r["c"]) for r in got if r["doc_id"] is not None} == {(k, v[1], v[2]) for k, v in want.items()}
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    assert written(spark, empty)[1].count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    with open(P.path("word_bpe_49k.json")) as f:
        encoder = token_files.ChunkEncoder(f.read())
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = np.random.default_rng(11)
    alphabet = [*"abcXYZ.,.,;'!- \n\t09", "İ", "é", "e\u0301", "ß", "Ω", "ﬁ", "中", "ا", "ि", "\u00a0", "\u0307", "ǅ", "'s", "İ,", "İ."]
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 14))) for _ in range(30_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want


# Operator 2


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark, docs):
    some = docs.where("doc_id < 120")
    base = " ".join(f"w{k}" for k in range(60))
    near = [base, base.replace("w3 ", "x "), base.replace("w50 ", "y "), base.replace("w20 ", "z ").replace("w40 ", "q "), base.upper(), "short one", "Short ONE", "short two", ""]
    plus = spark.createDataFrame([(1000 + i, t, None, None, None) for i, t in enumerate(near)], DOCS)
    rows = some.unionByName(plus)
    want = brute_components({r["doc_id"]: r["text"] for r in rows.collect()})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(rows.withColumn("N_Shingles", F.lit(0))).collect()}
    assert got == want


def test_jaccard_join_odd(spark, odd, empty):
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert by[0] == (0, 0) and by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (1, 3) and by[4] == (1, 3) and by[None][1] is None
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 3), (7, 7), (None, 1), (500, k := 501), (k, 502)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and got[7] == 3 and got[502] == 500 and 1 not in got


# Operator 3


def brute_tokens(word, scores, unknown):
    w, longest, best = token_counts.MARK + word, max(map(len, scores)), [(0, 0)]
    for i in range(1, len(w) + 1):
        top = None
        for k in range(max(0, i - longest), i):
            s = scores.get(w[k:i])
            if s is not None and (top is None or best[k][0] + s > top[0]):
                top = (best[k][0] + s, best[k][1] + 1)
        other = (best[i - 1][0] + unknown, best[i - 1][1] + len(w[i - 1].encode()))
        best.append(other if top is None or other[0] > top[0] else top)
    return best[-1]


def test_token_counts(spark, docs, odd, empty):
    path = P.path("piece_bpe_32k.model")
    scores = token_counts.scores_of(token_counts.load_pieces(path))
    unknown, memo = min(scores.values()) - token_counts.UNKNOWN, {}
    rows = docs.where("doc_id < 25").unionByName(odd.where("doc_id is not null"))
    for r in token_counts.token_counts(rows.withColumn("SCORE", F.lit("x")), path).collect():
        ws = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        for w in ws:
            if w not in memo:
                memo[w] = brute_tokens(w, scores, unknown)
        assert (r["n_words"], r["n_tokens"], r["score"]) == (len(ws), sum(memo[w][1] for w in ws), sum(memo[w][0] for w in ws))
    assert token_counts.token_counts(empty, path).count() == 0


# Operator 4


def test_alignment():
    a, b = "a b c d e f g".split(), "a x c d q f g".split()
    assert [a[i] for i, _ in license_scan.align(a, b)] == ["a", "c", "d", "f", "g"]
    assert license_scan.align([], b) == [] and license_scan.align(["z"], b) == []
    pairs = license_scan.align("k l m n o p".split(), "n o p k l m".split())
    assert len(pairs) == 3 and all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:], strict=False))


def test_license_scan(spark, docs, odd, empty):
    mit = license_scan.TEMPLATES["mit-permission"].split()
    changed = " ".join(w for k, w in enumerate(mit) if k % 8)
    filler = " ".join(f"w{k}" for k in range(50))
    texts = [f"{filler} {' '.join(mit)} {filler}", f"{changed}\n{filler}\n{changed}", "Released under the\nMIT License.", "Released under a license", filler]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {}
    for r in license_scan.license_scan(rows.withColumn("Coverage", F.lit(0))).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], r["first_word"], r["coverage"]))
    assert got[0] == [("mit-permission", 50, 1.0)]
    assert [x[0] for x in got[1]] == ["mit-permission"] * 2 and all(x[2] > 0.8 for x in got[1])
    assert got[2] == [("mit-line", 0, 1.0)] and 3 not in got and 4 not in got
    lines = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3."]
    want = {r["doc_id"] for r in docs.collect() if any(x in (r["text"] or "") for x in lines)}
    assert want <= {r["doc_id"] for r in license_scan.license_scan(docs).collect()}
    assert license_scan.license_scan(odd).count() == 0 and license_scan.license_scan(empty).count() == 0


# Operator 5


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"Menu | Home\nunique {i}\n\nshared", "en", "a", None) for i in range(20)] + [(100 + i, f"Menu | Home\nother {i}", "en", "b", None) for i in range(3)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS).withColumn("N_LINES", F.lit(1))).collect()}
    assert got[3] == ("unique 3\n", 4, 2) and got[101] == ("Menu | Home\nother 1", 2, 0)
    out = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS), broadcast_lines=0)
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()} == got
    whole = [(i, "same", None, None, None) for i in range(9)]
    assert all(r["text"] == "same" for r in line_dedup.line_dedup(spark.createDataFrame(whole, DOCS)).collect())
    odd_out = line_dedup.line_dedup(odd).collect()
    assert len(odd_out) == odd.count() and sum(r["text"] is None for r in odd_out) == 1
    assert line_dedup.line_dedup(empty).count() == 0


# Operator 6


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected_digests(encoding, rows):
    want = Counter()
    for r in rows:
        ids = encoding.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    return want


def test_byte_bpe(spark, docs, odd, empty, encoding):
    rng = np.random.default_rng(5)
    blob = "".join(map(chr, rng.integers(97, 123, 100_000)))
    long = spark.createDataFrame([(900, blob, None, None, None), (901, "a" * 100_000, None, None, None), (902, f"x {'-' * 70}{blob[:90]} y", None, None, None)], DOCS)
    rows = docs.where("doc_id < 40").unionByName(odd.where("doc_id is not null")).unionByName(long).withColumn("IDS", F.lit(0))
    out = byte_bpe.digests(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == expected_digests(encoding, rows.collect())
    assert byte_bpe.digests(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_byte_bpe_without_frequent_words(spark, docs, odd, encoding):
    rows = docs.where("doc_id < 4").unionByName(odd).withColumn("IDS", F.lit(0)).withColumn("many", F.array(F.struct(F.lit(1).alias("k"))))
    made = byte_bpe.encode(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, frequent=10)
    assert [c for c in made.columns if c.lower() == "ids"] == ["ids"] and set(made.columns) >= {"many", "lang"}
    out = byte_bpe.decode(made, P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(out) == rows.count() and all(r["many"][0]["k"] == 1 for r in out)
    assert all(list(r["ids"]) == encoding.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in out)


# Operator 7


def test_quality(spark, odd, empty):
    good = [(i, " ".join(f"w{i}x{k}" for k in range(40 + i % 5)), "en", "a", None) for i in range(40)]
    loud = [(900, " ".join(f"## {k} $$ %% word{k}" for k in range(40)), "en", "a", None)]
    again = [(901, "the same eight words over and over again " * 9, "en", "a", None), (902, "too short", "en", "a", None)]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(good + loud + again, DOCS).withColumn("Kept", F.lit(1))).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not got[900]["kept"] and not got[900]["base_failed"]
    assert got[901]["base_failed"] and got[901]["n_repeat_words"] == got[901]["n_words"] == 72 and got[902]["base_failed"]
    out = quality.quality(odd).collect()
    assert len(out) == odd.count() and not any(r["kept"] for r in out if r["n_words"] < 20)
    assert quality.quality(empty).count() == 0


# Operator 8


def test_language_id(spark, sf, odd, empty):
    out = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert out and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out) and all(0 <= r["score"] <= 1 for r in out)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd.withColumn("Lang_Pred", F.lit(1)), model).collect()}
    assert len(got) == 12 and all(got[i] == ("und", 0.0) for i in (0, 1, 2, 10)) and got[3][0] != "und" and got[6][0] != "und"
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, language_id.train(empty)).collect()} == {"und"}


def test_language_spans(spark, docs):
    by = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(3).collect()).split()[:60] for lang in ("en", "de")}
    mixed = spark.createDataFrame([(1, " ".join(by["en"] + by["de"]))], "doc_id long, text string")
    spans = language_id.identify(mixed, language_id.train(docs), spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["last"] - 60) <= 3


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for n in (1, 2, 6):
        scores = rng.normal(size=(n, 3)).astype(np.float32) * 3
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(language_id.viterbi(scores, np.array([0, n]), 2.0)) == best


# Operator 9


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/712?x", "https://x.com/en/5", "http://com/en/", "http://notcom/en/", "https://a.net/de/8#f", "http://q.example.net/de/81", "http://z.org/es/", "no scheme/en/", None, "", "x://?a/en/", "http://b.com/fr/9"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(rows).collect()}
    assert got[0] == ("a.example.com", "/en/712", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2] == "com/en/" and got[3][2] is None
    assert got[4][2:] == ("net/de/", "block") and got[5][2:] == ("example.net/de/8", "allow") and got[6][3] == "block"
    assert all(got[i][:3] == ("", "", None) for i in (7, 8, 9, 10)) and all(v[3] in ("allow", "block") for v in got.values())
    none = url_filter.url_filter(rows.where("page_id = 11"))
    assert [r["verdict"] for r in none.collect()] == ["allow"] and url_filter.url_filter(rows.where("false")).count() == 0


def test_url_model_learns(spark):
    rows = [(f"http://site{i % 50}.com/{'a/b/c/d' if i % 2 else 'p'}/{'9' * 12 if i % 2 else 'story'}", i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "url string, label int")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    model = url_filter.train(df.where("crc32(url) % 5 <> 0"))
    held = model.verdicts(df.where("crc32(url) % 5 = 0")).collect()
    assert held and sum((r["model_verdict"] == "block") == (r["label"] == 1) for r in held) >= 0.95 * len(held)


# Operator 10


def test_decontaminate(spark, docs, odd, empty, sf):
    item = "A farmer sells 12 apples to Maria for 3 dollars each morning and keeps 5 pears in the old wooden barn near the river bend"
    changed = item.replace("12", "40").replace("Maria", "Olga").replace("3 dollars", "7 euros").replace("5", "9")
    clean = "The council met on Tuesday to discuss the new bridge, the budget for parks and the plan to repair several roads in the north"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (1, item)], "item_id long, text string")
    rows = [(1, f"intro words here. {item} and more", None, None, None), (2, f"before that {changed} after", None, None, None), (3, clean, None, None, None), (4, None, None, None, None), (1, f"intro words here. {item} and more", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: (r["item_id"], r["n_changed"] > 0) for r in decontaminate.find_leaks(df, items).collect()}
    assert found == {1: (1, False), 2: (1, True)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df.withColumn("shift", F.lit(1)), items).collect()) == [3, 4]
    assert {r["doc_id"] for r in decontaminate.find_leaks(df, items, broadcast_windows=0).collect()} == {1, 2}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [r["text"] for r in bench.collect()]
    planted = {r["doc_id"] for r in docs.collect() if any(t in (r["text"] or "") for t in texts)}
    assert planted <= {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.decontaminate(df, items.where("false")).count() == 5


ITEM = "every clerk in that shop sold 12 long red ribbons before noon to Maria who then gave them back for 3 dollars without any receipt"


def leaks(spark, texts, item=ITEM):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r for r in decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}


def test_decontaminate_values_of_another_length(spark):
    head = "some words come first and "
    texts = [
        head + ITEM.replace("Maria", "Anna Olga Petrova").replace("12", "7"), head + ITEM.replace("3 dollars", "$3").replace("Maria", "Eva Lind"),
        head + ITEM.replace("before noon", "well before noon"), head + ITEM.replace("long red", "red"), head + "a text about nothing of the kind " * 5,
    ]
    got = leaks(spark, texts)
    assert sorted(got) == [0, 1, 2, 3] and all(r["agreement"] == 1 for r in got.values())
    assert got[0]["n_matched"] == got[0]["n_windows"] == got[1]["n_matched"] and (got[0]["n_slots"], got[0]["n_changed"]) == (4, 2)
    assert got[2]["n_changed"] == got[3]["n_changed"] == 0 and got[2]["n_slots"] == 4 and got[3]["n_slots"] >= 3
    short = leaks(spark, ["they add 5 and go", "they add 1 2 3 4 5 6 7 8 9 and go"], "Add 1 2 3 4 5 6 7 8 9")
    assert sorted(short) == [1]


def test_decontaminate_checks_every_alignment(spark):
    item = "the first of two old barns holds 12 bales of dry hay and the second one holds 12 bales of wet straw"
    wrong = item.replace("12", "40", 1).replace("12", "7", 1)
    filler = " ".join(f"w{chr(97 + k)}" for k in range(20))
    got = leaks(spark, [f"{filler} {wrong} {filler} {item} {filler}", f"{filler} {wrong} {filler}", f"{filler} {item}"], item)
    assert sorted(got) == [0, 2] and got[0]["n_changed"] == 0 and got[0]["agreement"] == 1


def test_license_copies_close_together():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    line = "Released under the MIT License."
    assert scanner.scan(f"x {line} {line} y") == [("mit-line", 1, 6, 5, 5), ("mit-line", 6, 11, 5, 5)]
    filler = " ".join(f"w{k}" for k in range(7))
    for name in ("mit-permission", "gpl-3-notice", "mpl-2.0-notice"):
        text, n = license_scan.TEMPLATES[name], len(scanner.words[name])
        for copies in (2, 3, 9):
            got = [x for x in scanner.scan(f"{filler} {' '.join([text] * copies)} {filler}") if x[0] == name]
            assert got == [(name, 7 + n * k, 7 + n * (k + 1), n, n) for k in range(copies)], (name, copies)


def test_jaccard_join_null_id_before_copies(spark):
    base = " ".join(f"w{k}" for k in range(60))
    near = [base] + [base.replace(f"w{k} ", "x ", 1) for k in (3, 20, 40, 50)]
    texts = [(None, t) for t in near] + list(enumerate(near, 1))
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS).coalesce(1)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(rows).collect()}
    want = {i: c for i, (_, c) in brute_components({i: t for i, t in texts if i is not None}).items()}
    assert got == {**want, None: None} and set(want.values()) == {1}


def test_license_needs_its_telling_words():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    names = lambda text: [f[0] for f in scanner.scan(text)]
    assert names("The film was released under the license of its studio.") == []
    assert names("Released under the Apache License.") == names("Licensed under the MIT License, Version 2.0.") == []
    assert names("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0-line"] and names("Licensed under CC BY 4.0.") == ["cc-by-4.0-line"]
    assert names(f"a {license_scan.TEMPLATES['apache-2.0-notice']} b") == ["apache-2.0-notice"]


def brute_licenses(text):
    """Every window of a line's length that is the line, but those inside a longer line; by plain comparison."""
    words = license_scan.normal_words(text)
    lines = {n: license_scan.normal_words(t) for n, t in license_scan.TEMPLATES.items() if len(license_scan.normal_words(t)) <= license_scan.LINE}
    return sorted((k, n) for n, ws in lines.items() for k in range(len(words)) if words[k : k + len(ws)] == ws)


def test_license_scan_against_brute_force(docs):
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)
    texts = [r["text"] or "" for r in docs.collect()]
    lines = [t for n, t in license_scan.TEMPLATES.items() if n.endswith("line")]
    texts += [f"x {a} y z {b} {a}" for a in lines for b in lines]
    for text in texts:
        assert sorted((f[1], f[0]) for f in scanner.scan(text) if f[0].endswith("line")) == brute_licenses(text)


def test_decontaminate_short_items(spark):
    items = spark.createDataFrame([(1, "42"), (2, "Paris 12"), (3, "what is 12 times 7?")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "In 1999 there were 42 trees."), (2, "So what is 12 times 7? Say it."), (3, "So what is 13 times 8? Say it."), (4, None)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(rows, items).collect()] == [(2, 3)]


def test_license_neighbours_against_brute_force():
    """Every exact copy is told, of lines and of notices, beside every other one; those that stand in a longer copy aren't."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.COVERAGE)

    def brute(text):
        words = license_scan.normal_words(text)
        copies = [(k, k + len(ws), name) for name, ws in scanner.words.items() for k in range(len(words) - len(ws) + 1) if words[k : k + len(ws)] == ws]
        return sorted((k, name) for k, end, name in copies if not any(i <= k and end <= j and j - i > end - k for i, j, _ in copies))

    for a in license_scan.TEMPLATES.values():
        for b in license_scan.TEMPLATES.values():
            for text in (f"x {a} y z {b} {a}", f"{a} {b}", f"{b} and the film was licensed under seal {a}"):
                assert [(f[1], f[0]) for f in scanner.scan(text)] == brute(text), text


def test_license_shortest_stretch():
    words, template = "licensed under cc by 4.0 licensed under cc by-nc 4.0".split(), "licensed under cc by-nc 4.0".split()
    at = license_scan.align(words, template)
    assert license_scan.shortest(words, 0, at, template) == (5, 10, template)


def brute_rows(rows):
    """Components of rows (doc_id, text): those of their sets, those of one doc_id put together."""
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {" ".join(w)} if w else set()

    sets, ids = [shingles(t) for _, t in rows], [i for i, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            alike = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
            if ids[i] is not None and ids[j] is not None and (alike or ids[i] == ids[j]):
                root[find(i)] = find(j)
    least = {}
    for k in range(len(rows)):
        if ids[k] is not None:
            least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, (i, s) in enumerate(zip(ids, sets, strict=True))), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_repeated_ids_with_other_texts(spark, seed):
    import random

    rng = random.Random(seed)
    bases = [[f"b{k}w{j}" for j in range(rng.choice([12, 24, 60]))] for k in range(12)]
    rows = []
    for _ in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((rng.choice([None, *range(40)]) if rng.random() < 0.3 else rng.randrange(40, 120), rng.choice([None, "", " ".join(words), " ".join(words), " ".join(words)])))
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_rows(rows)


def test_decontaminate_capitals_and_number_words(spark):
    heading = "Name the largest planet of the system"
    texts = ["So: NAME THE LARGEST PLANET OF THE SYSTEM.", "A quiz\nName The Largest Planet Of The System\nand more", "name the largest moon of the system"]
    assert sorted(leaks(spark, texts, heading)) == [0, 1]
    item = "a farmer sells twelve red apples for 3 dollars each morning and keeps twenty-five pears in the old barn"
    texts = [item.replace("twelve", "40").replace("twenty-five", "ninety nine"), item.upper(), item.replace("3 dollars", "seven euros"), "a farmer sells red apples each morning"]
    got = leaks(spark, [f"so it is said by the river. {t}. that was it" for t in texts], item)
    assert sorted(got) == [0, 1, 2] and (got[0]["n_changed"], got[1]["n_changed"]) == (2, 0) and got[2]["n_changed"] == 2


def brute_template(text):
    """Template words with the value of each run of placeholders, word by word."""
    tens = decontaminate.TENS
    numbers = {*decontaminate.NUMBER_WORDS, *tens, *[f"{t}-{o}" for t in tens for o in ["one", *decontaminate.NUMBER_WORDS[1:9]]]}
    units = set(decontaminate.UNITS)
    small = set("a an and at by for from in is of on or the to with".split())
    ws = []
    for part in re.split(r"\n|(?<=[.!?:'\")\]])[ \t\r]", text):
        here = re.findall(r"[^ \t-\r]+", part)
        plain = len(here) >= 4 and not any(re.match(r"[('\"]*[a-z]", w) and re.sub(r"^[('\"]*|\W.*$", "", w) not in small for w in here)
        ws += [w.lower() if plain else w for w in here]
    cores = [re.sub(r"^[^\w%]+|[^\w%]+$", "", w) for w in ws]
    out = []
    for i, (w, core) in enumerate(zip(ws, cores, strict=True)):
        number = lambda k: bool(re.search("[0-9]", ws[k])) or cores[k].lower() in numbers
        starts = i == 0 or re.search(r"[.!?:]['\")\]]*$", ws[i - 1])
        kind = "<number>" if number(i) else "<unit>" if i and core.lower() in units and number(i - 1) else "<name>" if core.lower() != core and not starts else None
        joins = out and (kind == "<unit>" or (kind == "<number>" and out[-1][2] in ("<number>", "<unit>")) or (kind == "<name>" and out[-1][2] == "<name>"))
        if joins:
            out[-1][1].append((kind, core.lower()))
            out[-1][2] = kind
        else:
            out.append([kind or core.lower(), [(kind, core.lower())], kind])
    return [(t, tuple(v for k, v in run if k == t)) for t, run, _ in out]


def brute_leak(text, item, width=decontaminate.WINDOW):
    """Whether half of the item's windows stand within a few words of one alignment whose slots agree; for values of one length."""
    d, x = brute_template(text), brute_template(item)
    n = len(x) - width + 1
    hits = [(j - i, i) for i in range(n) for j in range(len(d) - width + 1) if all(x[i + k][0] == d[j + k][0] for k in range(width))]
    for shift in {s for s, _ in hits}:
        met = {i for s, i in hits if abs(s - shift) <= decontaminate.SLACK}
        pairs = {(x[k][1], d[k + shift][1]) for k in range(len(x)) if 0 <= k + shift < len(d) and x[k][0] == d[k + shift][0] and x[k][0][0] == "<"}
        if 2 * len(met) >= n and (not pairs or min(len({a for a, _ in pairs}), len({b for _, b in pairs})) >= decontaminate.AGREEMENT * len(pairs)):
            return True
    return False


def test_decontaminate_against_brute_force(spark):
    import random

    rng = random.Random(5)
    plain = "river barn apple wagon stone cloud lamp horse bread wheel".split()
    value = lambda: rng.choice([str(rng.randrange(9)), "seven", "Maria", "Olga"])
    items = [" ".join(value() if k % 5 == 4 else rng.choice(plain) for k in range(rng.randrange(12, 24))) for _ in range(12)]
    texts = []
    for item in items * 6:
        ws = [value() if re.search("[0-9A-Z]|seven", w) and rng.random() < 0.5 else w for w in item.split()]
        cut = rng.choice([0, 0, len(ws) // 3, len(ws) // 2])
        texts.append(" ".join([rng.choice(plain) for _ in range(rng.randrange(5))] + ws[cut:] + [rng.choice(plain) for _ in range(5)]))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    found = decontaminate.find_leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = {(i, j) for i, t in enumerate(texts) for j, item in enumerate(items) if brute_leak(t, item)}
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and 20 < len(want) < len(texts) * 2
