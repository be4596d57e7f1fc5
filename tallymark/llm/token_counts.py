"""Operator 3, token counts: unigram segmentation of words by dynamic programming shared over a trie.

Distinct words form a trie, which a task walks depth first in the order of the sorted words. A node holds the best score of any segmentation of its prefix and the
number of tokens of that segmentation; it follows from its ancestors' alone, so a prefix is computed once for all
words that share it. A word's token count is read at its terminal node. Documents add up their words' counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, workers_ready

#: Bounds of a Python worker's table of terminal counts: words (it starts anew beyond), and characters of a word in
#: it. Longer words go through the same recurrence one by one.
WORDS, WORD_CHARS = 800_000, 48
#: A character that no piece covers costs this much more than the dearest piece and counts a token a UTF-8 byte.
UNKNOWN = 10_000_000
MARK = "▁"

_LOADED: dict = {}


def scores_of(pieces_by_rank: list[str]) -> dict[str, int]:
    """Score of each piece in whole millionths: Zipf's law by rank, -ln(rank + 1). Whole numbers add exactly."""
    return {p: -round(1e6 * math.log(rank + 1)) for rank, p in enumerate(pieces_by_rank, 1)}


def load_pieces(model_path: str) -> list[str]:
    """Normal pieces of a sentencepiece model in the order of their ids (control, byte and unknown pieces left out)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    n = model.vocab_size()
    return [model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]


class Trie:
    """Depth-first walk over the trie of sorted distinct words.

    Only the nodes on the way to the present word are held. A node keeps the best score of its prefix, the tokens
    of that segmentation, and the pieces that a later character may still end: (score, tokens) of the prefix that
    each begins after, with its place in the trie of pieces. Terminal counts are stored by word.
    """

    def __init__(self, scores: dict[str, int]):
        self.root: dict = {}
        for piece, s in scores.items():
            at = self.root
            for c in piece:
                at = at.setdefault(c, {})
            at[""] = s
        self.unknown = min(scores.values(), default=0) - UNKNOWN
        self.start = self._below((0, 0, [(0, 0, self.root)]), MARK)
        #: Of each word its tokens and, times 65536, its score turned positive.
        self.terminal: dict[str, int] = {}

    def _below(self, node: tuple, c: str) -> tuple:
        """The child of a node. Of segmentations with one score the one with the longer last piece counts."""
        score, tokens, begun = node
        top, top_tokens, still = score + self.unknown - 1, 0, []
        for b, t, at in begun:
            nxt = at.get(c)
            if nxt is not None:
                still.append((b, t, nxt))
                s = nxt.get("")
                if s is not None and b + s > top:
                    top, top_tokens = b + s, t + 1
        if score + self.unknown > top:
            top, top_tokens = score + self.unknown, tokens + len(c.encode("utf-8", "surrogatepass"))
        still.append((top, top_tokens, self.root))
        return top, top_tokens, still

    def long(self, word: str) -> tuple[int, int]:
        """Score and tokens of one word."""
        node = self.start
        for c in word:
            node = self._below(node, c)
        return node[0], node[1]

    def insert(self, words: list[str]) -> None:
        """Store the counts of sorted distinct words; a prefix that neighbours share is computed once."""
        path, before, below, terminal = [self.start], "", self._below, self.terminal
        for w in words:
            k = 0
            for x, y in zip(w, before, strict=False):
                if x != y:
                    break
                k += 1
            del path[k + 1 :]
            node = path[k]
            for c in w[k:]:
                node = below(node, c)
                path.append(node)
            terminal[w] = (-node[0] << 16) | node[1]
            before = w


_WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def token_counts(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """df with n_words, n_tokens and score (long; whole millionths of a nat) of each whole text.

    Words are `[^\\x20\\x09-\\x0D]+`, each after a word mark. Null and empty texts have none. Columns of df with
    these names are replaced. Equal rows count alike; an empty table gives an empty table. The pieces are read
    on the driver and broadcast (a fixed vocabulary). Nothing is shuffled: a task's trie is bounded, and what a
    word counts doesn't depend on the words before it.
    """
    spark: SparkSession = df.sparkSession
    workers_ready(spark)
    vocabulary = load_pieces(model_path)
    key = hash(tuple(vocabulary))
    shared = spark.sparkContext.broadcast(vocabulary)
    new = ["n_words", "n_tokens", "score"]
    rest = [c for c in df.columns if c.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LOADED.get("key") != key:
            _LOADED.update(key=key, trie=Trie(scores_of(shared.value)))
        trie: Trie = _LOADED["trie"]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for lo, hi in pieces(texts):
                split = [_split(t or "") for t in texts[lo:hi].to_pylist()]
                if len(trie.terminal) > WORDS:
                    trie.terminal.clear()
                found, fresh = trie.terminal, set()
                for ws in split:
                    fresh.update(set(ws).difference(found))
                lengthy = {w: trie.long(w) for w in fresh if len(w) > WORD_CHARS}
                trie.insert(sorted(fresh.difference(lengthy)))
                n_words, n_tokens, score = [len(ws) for ws in split], [], []
                for ws in split:
                    own = [lengthy[w] for w in ws if w in lengthy] if lengthy else []
                    got = np.fromiter((found.get(w, 0) for w in ws) if own else map(found.__getitem__, ws), np.int64, len(ws))
                    n_tokens.append(int((got & 0xFFFF).sum()) + sum(t for _, t in own))
                    score.append(sum(b for b, _ in own) - int((got >> 16).sum()))
                cols = [c[lo:hi] for c in batch.columns[:-1]] + [pa.array(x, pa.int64()) for x in (n_words, n_tokens, score)]
                yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-1], *new])

    work = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.col(f"`{text}`").alias("__text"))
    schema = "".join(f"c{i} {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(rest)) + "n_words long, n_tokens long, score long"
    out = work.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], *new)


def _split(text: str) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    if text.isascii():  # str.split() also splits at 1C-1F, which are no white space here
        return _WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    return _WORD.findall(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = token_counts(docs.select("doc_id", F.col("text").alias("__t")), public_tokenizers.path("piece_bpe_32k.model"), "__t")
    return counted.select("doc_id", "n_words", "n_tokens", "score")
