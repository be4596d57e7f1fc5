"""Operator 8, language ID: script ranges narrow the languages, then Viterbi over per-word scores labels spans.

A word's score for a language is the sum of the log probabilities of its byte trigrams, learned by counting. A
path through the words pays a penalty for every change of language, so a span needs evidence of its own. The
words of many texts are scored with array operations, and the paths of all texts of a piece advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_share, pieces, workers_ready

#: Bound of the training sample: documents of each language (twice as many at most).
TRAIN_DOCS = 1500
#: Bytes of text whose words are scored at a time (a longer text stands alone): about 60 times that in arrays.
PIECE = 2 << 20
#: Cells of the trigram table of a language (fixed size), and the count that each starts with.
CELL_BITS, PRIOR = 16, 0.5
#: Cost of a change of language, and of a word in a script that the language isn't written in.
SWITCH, FOREIGN = 12.0, 20.0
#: A language is written in a script if at least this share of its letters is.
SCRIPT_SHARE = 0.005

#: First and last code point of ranges of letters, and the script's bit.
SCRIPTS = [
    (0x0041, 0x005A, 0), (0x0061, 0x007A, 0), (0x00C0, 0x024F, 0), (0x1E00, 0x1EFF, 0),  # Latin
    (0x0370, 0x03FF, 1), (0x1F00, 0x1FFF, 1),  # Greek
    (0x0400, 0x052F, 2),  # Cyrillic
    (0x0530, 0x058F, 3), (0x0590, 0x05FF, 4), (0x0600, 0x077F, 5),  # Armenian, Hebrew, Arabic
    (0x0900, 0x097F, 6), (0x0980, 0x09FF, 7), (0x0B80, 0x0BFF, 8), (0x0C00, 0x0C7F, 9),  # Devanagari, Bengali, Tamil, Telugu
    (0x0E00, 0x0E7F, 10), (0x10A0, 0x10FF, 11), (0x1100, 0x11FF, 12), (0xAC00, 0xD7AF, 12),  # Thai, Georgian, Hangul
    (0x3040, 0x309F, 13), (0x30A0, 0x30FF, 14), (0x3400, 0x4DBF, 15), (0x4E00, 0x9FFF, 15),  # Hiragana, Katakana, Han
]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes as the trigrams see them: A-Z as a-z, digits as one, other ASCII marks as one, white space as one.
_SEEN = np.arange(256, dtype=np.uint32)
_SEEN[:128] = 0x2E
_SEEN[48:58] = 0x30
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[SPACE] = 0x20


def _script_bits() -> np.ndarray:
    """Bit of the script by a character's first two UTF-8 bytes (one for ASCII: second byte 0); 0 where none is meant."""
    out = np.zeros(1 << 16, np.int32)
    for first, last, bit in SCRIPTS:
        for c in range(first, last + 1):
            b = chr(c).encode()
            out[(b[0] << 8) | (b[1] if len(b) > 1 else 0)] |= 1 << bit
    return out


_SCRIPT = _script_bits()
_LETTER = regex.compile(r"\p{L}")


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of some texts: trigram cells by byte, and each word's text, place, script and letters."""

    def __init__(self, texts: pa.Array):
        texts = pa.array(texts.to_pylist(), pa.large_string()) if texts.null_count else texts.cast(pa.large_string())
        sizes = texts.to_pylist()
        raw = [(t or "").encode() for t in sizes]
        # Texts stand between spaces, so no trigram and no word crosses from one to another.
        buf = np.frombuffer(b" " + b" ".join(raw) + b"  ", np.uint8)
        self.starts = np.cumsum([1, *(len(r) + 1 for r in raw)])
        space = SPACE[buf]
        seen = _SEEN[buf]
        tri = (seen[:-2] << np.uint32(16)) | (seen[1:-1] << np.uint32(8)) | seen[2:]
        self.cells = ((tri * np.uint32(2654435761)) >> np.uint32(32 - CELL_BITS)).astype(np.int32)  # of byte i + 1
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = edge[::2], edge[1::2]
        lead = buf >= 0xC0
        letters = ASCII_LETTER[buf] | lead
        run = np.concatenate(([0], np.cumsum(letters)))
        self.letters = run[self.end] - run[self.begin]
        second = np.where(lead[:-1], buf[1:], 0).astype(np.int32)
        bits = np.where(letters[:-1], _SCRIPT[(buf[:-1].astype(np.int32) << 8) | second], 0)
        self.scripts = np.bitwise_or.reduceat(bits, self.begin) if len(self.begin) else np.zeros(0, np.int32)
        self.bounds = np.searchsorted(self.begin, self.starts)  # of text i: words bounds[i]:bounds[i + 1]
        plain = np.concatenate(([0], np.cumsum(ASCII_LETTER[buf])))
        has = plain[self.starts[1:] - 1] > plain[self.starts[:-1]]
        self.has_letter = np.array([bool(h) or bool(t and _LETTER.search(t)) for h, t in zip(has, sizes, strict=True)], bool)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """Sum over each word of the table's values at its trigrams; 0 for words without letters."""
        run = np.concatenate(([0.0], np.cumsum(table[self.cells], dtype=np.float64)))  # run[k]: bytes 1..k
        return np.where(self.letters > 0, run[self.end - 1] - run[self.begin - 1], 0.0)


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of each word on its text's best path. scores: words by languages; ties go to the earlier language."""
    n_lang = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    longest = int(size[0]) if len(size) else 0
    if not longest or n_lang == 1:
        return labels
    active = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
    now = scores[first[: active[0]]].copy()
    back = [np.empty(0)] * longest
    rest = np.empty(len(size), np.int64)  # state at a text's last word
    for t in range(1, longest):
        a, before = int(active[t]), int(active[t - 1])
        if a < before:
            rest[a:before] = now[a:before].argmax(1)
            now = now[:a]
        top = now.argmax(1)
        moved = now[np.arange(a), top][:, None] - switch
        back[t] = np.where(now >= moved, -1, top[:, None]).astype(np.int16)
        now = np.maximum(now, moved) + scores[first[:a] + t]
    rest[: len(now)] = now.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = int(active[t])
        labels[first[:a] + t] = rest[:a]
        if t:
            step = back[t][np.arange(a), rest[:a]]
            rest[:a] = np.where(step >= 0, step, rest[:a])
    return labels


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by language and cell, script mask by language) from labelled texts.

    About `rows` documents of each language, chosen by the hash of `key`; whole texts. Trigrams are counted in
    tasks; a task gives one row a language, and the driver gets one row a language of fixed size.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    counts = sorted((r["lang"], r["n"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return [], np.zeros((0, 1 << CELL_BITS)), np.zeros(0, np.int64)
    wanted = F.lit(False)
    for name, n in counts:
        wanted = wanted | ((F.col("lang") == name) & in_share(F.col("key"), rows / n))
    n_bits = 1 + max(b for _, _, b in SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi in pieces(batch.column(1), PIECE):
                w = Words(batch.column(1)[lo:hi])
                for i in range(hi - lo):
                    a, b = w.bounds[i], w.bounds[i + 1]
                    out = sums.setdefault(langs[lo + i], np.zeros((1 << CELL_BITS) + n_bits, np.int64))
                    if a < b:
                        np.add.at(out, w.cells[w.begin[a] - 1 : w.end[b - 1] - 1], 1)
                        for bit in range(n_bits):
                            out[(1 << CELL_BITS) + bit] += w.letters[a:b][(w.scripts[a:b] >> bit) & 1 == 1].sum()
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tobytes()], pa.binary())], ["lang", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer(), np.int64)
                sums[name] = sums[name] + x if name in sums else x
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([v.tobytes()], pa.binary())], ["lang", "v"])

    kind = "lang string, v binary"
    made = docs.where(wanted).select("lang", "text").mapInArrow(count, kind).repartition("lang").mapInArrow(add, kind)
    table = {r["lang"]: np.frombuffer(bytes(r["v"]), np.int64) for r in made.collect()}
    names = sorted(table)
    grams = np.array([table[n][: 1 << CELL_BITS] for n in names], np.float64) + PRIOR
    scripts = np.array([table[n][1 << CELL_BITS :] for n in names], np.float64)
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    masks = ((share >= SCRIPT_SHARE) @ (1 << np.arange(n_bits))).astype(np.int64)
    return names, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), masks


def identify(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text", spans: bool = False) -> DataFrame:
    """df with lang_pred, score and, if asked for, spans (array of lang, first word, word after the last).

    lang_pred: the language that most letters are labelled with; score: their share of the letters. `und` and 0
    for a null text or one without letters, and for all texts if the model has no language. Columns of df with
    these names are replaced. Whole texts count. Equal texts are judged alike; an empty table gives an empty one.
    """
    spark: SparkSession = df.sparkSession
    workers_ready(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed table a language
    new = ["lang_pred", "score", *(["spans"] if spans else [])]
    rest = [c for c in df.columns if c.lower() not in new]
    carried = [f"c{i}" for i in range(len(rest))]
    extra = [] if text in rest else [F.col(f"`{text}`").alias("__text")]  # a text that stays is sent once
    at = rest.index(text) if text in rest else len(rest)
    work = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, carried, strict=True)], *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, masks = shared.value
        for batch in batches:
            texts = batch.column(at)
            for lo, hi in pieces(texts, PIECE):
                part = batch.slice(lo, hi - lo)
                w = Words(texts[lo:hi])
                langs, shares, found = ["und"] * (hi - lo), [0.0] * (hi - lo), [[] for _ in range(hi - lo)]
                if names and len(w.begin):
                    scores = np.column_stack([w.sums(t) for t in table]).astype(np.float32)
                    foreign = (w.scripts[:, None] & ~masks[None, :]) != 0
                    scores -= np.where(foreign & ~foreign.all(1, keepdims=True), np.float32(FOREIGN), np.float32(0)) * (w.letters > 0)[:, None]
                    labels = viterbi(scores, w.bounds)
                    for i in np.flatnonzero(w.has_letter).tolist():
                        a, b = w.bounds[i], w.bounds[i + 1]
                        votes = np.bincount(labels[a:b], weights=w.letters[a:b], minlength=len(names))
                        best, total = int(votes.argmax()), votes.sum()
                        langs[i], shares[i] = names[best], float(votes[best] / total) if total else 1.0
                        if spans:
                            cut = np.flatnonzero(np.diff(labels[a:b])) + 1
                            edges = [0, *cut.tolist(), int(b - a)]
                            found[i] = [{"lang": names[labels[a + p]], "first": p, "last": q} for p, q in zip(edges, edges[1:], strict=False)]
                cols = [*part.columns[: len(rest)], pa.array(langs), pa.array(shares, pa.float64())]
                if spans:
                    cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, [*carried, *new])

    schema = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest)) + "lang_pred string, score double"
    out = work.mapInArrow(run, schema + (", spans array<struct<lang: string, first: int, last: int>>" if spans else ""))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *new)


def held_out(doc_id: Column) -> Column:
    """Fold of a document: true for those that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    work = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(work, model).drop("text")
