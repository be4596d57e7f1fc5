"""Operator 1, token-id files: zstandard frames of one document each, under one shared trained dictionary.

Format, a folder of Parquet tables:

* ``dictionary``: one row (dict_hash, dictionary, width, tokenizer_hash). dict_hash is the SHA-256 of the dictionary.
* ``blocks``: one row for up to a MiB of frames: shard, block, first (tokens of the shard before the block),
  dict_hash, min_id, max_id, the offset index (arrays doc_ids, offsets, lengths, counts), and `data`, the frames.
  A frame holds one document's ids as little-endian unsigned numbers of `width` bytes, ending with the end id.
* ``shards``: one row a shard (shard, start, n_docs, n_tokens): ids of all documents in the shards before it.

Documents stand in ascending doc_id order through the shards, which are the tasks of a range shuffle. The index
columns are read without the frames, so one short document costs its block's index, its block and one frame.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, in_share, materialise, new_path, pieces, workers_ready

#: Bounds of the dictionary and of its training sample: documents (twice as many at most) and characters of each.
DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 1 << 16, 1000, 8000
#: A block ends with the document that brings it to so many bytes, or at so many documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
#: Bounds of a Python worker's table of encoded chunks: entries, and characters of an entry.
CACHE_ENTRIES, CACHE_CHARS = 600_000, 64
#: Characters of new chunks that are encoded in one call.
JOIN_CHARS = 1 << 16

_LOADED: dict = {}


class ChunkEncoder:
    """Encodes texts by the chunks between ASCII spaces, each distinct chunk once as long as the table lasts.

    White space separates pre-tokens and is dropped by this kind of tokenizer, so the ids of a text are those of
    its chunks in order. A chunk of letters is one pre-token, whose last token alone carries the word-end mark;
    such chunks are encoded many at a time and cut at the marks, without a full stop or comma after them and in
    lower case. Other chunks are cut by the offsets that the library gives.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.normal = self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer is not None else str
        self.lower = self.normal("Q") == "q"
        self.width = 2 if len(self.ends) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {"": b""}
        self.tails = dict(zip("., ", [*self._by_offsets([".", ","]), b""], strict=True))

    def _by_offsets(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk of a text joined by spaces; a token belongs to the chunk that it starts in."""
        code = self.tokenizer.encode(" ".join(chunks), add_special_tokens=False)
        starts = np.cumsum([len(c) + 1 for c in chunks])
        firsts = np.fromiter((a for a, _ in code.offsets), np.int64, len(code.ids))
        return self._cut(np.array(code.ids, self.dtype), np.searchsorted(firsts, starts, "left"))

    def _by_marks(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters; where the marks don't tell one pre-token a word, the offsets decide."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return self._cut(ids, cuts) if len(cuts) == len(words) else self._by_offsets(words)

    def _cut(self, ids: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        raw, at = ids.tobytes(), [0, *(cuts * self.width).tolist()]
        return [raw[lo:hi] for lo, hi in pairwise(at)]

    def _ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new distinct chunks."""
        plain: dict[str, str] = {}
        for c in chunks:
            core = c[:-1] if c[-1] in ".," else c
            if core.isalpha() and (core.isascii() or self.normal(core).isalpha()):  # a capital may become a letter and a mark
                plain[c] = core.lower() if self.lower and core.isascii() else core
        ids = {w: b for w in plain.values() if (b := self.known.get(w)) is not None}
        ids.update(self._joined([w for w in dict.fromkeys(plain.values()) if w not in ids], self._by_marks))
        out = self._joined([c for c in chunks if c not in plain], self._by_offsets)
        out.update((c, ids[w] + self.tails[c[-1] if c[-1] in ".," else " "]) for c, w in plain.items())
        return out

    @staticmethod
    def _joined(chunks: list[str], encode) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        part: list[str] = []
        length = 0
        for k, c in enumerate(chunks, 1):
            part.append(c)
            length += len(c) + 1
            if length >= JOIN_CHARS or k == len(chunks):
                out.update(zip(part, encode(part), strict=True))
                part, length = [], 0
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the new chunks of all texts are encoded together."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
            known[""] = b""
        parts = [list(map(known.get, chunks)) for chunks in split]
        gaps = [[i for i, p in enumerate(ps) if p is None] if None in ps else () for ps in parts]
        fresh = self._ids(list(dict.fromkeys(chunks[i] for chunks, at in zip(split, gaps, strict=True) for i in at)))
        for chunks, ps, at in zip(split, parts, gaps, strict=True):
            for i in at:
                ps[i] = fresh[chunks[i]]
        known.update(fresh)
        for c in fresh:
            if len(c) > CACHE_CHARS:
                del known[c]
        return [b"".join(ps) for ps in parts]


def _encoder(key: str, tokenizer_json: str) -> ChunkEncoder:
    if _LOADED.get("key") != key:
        _LOADED.update(key=key, encoder=ChunkEncoder(tokenizer_json))
    return _LOADED["encoder"]


def _raw_ids(docs: DataFrame, doc_id: str, text: str, tokenizer, key: str, end_id: int, frames_of=None) -> DataFrame:
    """(doc_id, n_tokens, frame) of every row; the frame is the plain ids, or what frames_of() makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, tokenizer.value)
        end = np.array([end_id], encoder.dtype).tobytes()
        pack = frames_of() if frames_of else bytes
        for batch in batches:
            for lo, hi in pieces(batch.column(1)):
                ids = [b + end for b in encoder.encode([t or "" for t in batch.column(1)[lo:hi].to_pylist()])]
                counts = pa.array([len(b) // encoder.width for b in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], counts, pa.array(map(pack, ids), pa.binary())], ["doc_id", "n_tokens", "frame"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, frame binary")


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; with too few samples to train on, their plain bytes (zstandard takes those as content)."""
    samples = sorted(s for s in samples if s)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 8


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", level: int = 3
) -> None:
    """Encode every whole text, append end_id, and write the folder `path` described above.

    Null and empty texts are the end id alone. Rows of one doc_id stand together, ordered by their frames; null
    doc_ids come first. Equal rows are all written. An empty table gives files without blocks. Other columns of
    docs are not read. tokenizer_path is read on the driver; the dictionary is trained on a bounded sample
    (SAMPLE_DOCS documents of at most SAMPLE_CHARS characters, chosen by the hash of the doc_id) and only
    decides how small the frames get. The frames go through the shared folder and one range shuffle.
    """
    spark: SparkSession = docs.sparkSession
    workers_ready(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    tokenizer = spark.sparkContext.broadcast(tokenizer_json)
    width = ChunkEncoder(tokenizer_json).width
    total = docs.count()
    chosen = in_share(F.col(doc_id), SAMPLE_DOCS / max(total, 1)) & (F.length(text) <= SAMPLE_CHARS)
    sample = docs.where(chosen).limit(2 * SAMPLE_DOCS)
    dictionary = train_dictionary([bytes(r["frame"]) for r in _raw_ids(sample, doc_id, text, tokenizer, key, end_id).collect()])
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary), width, key)], "dict_hash string, dictionary binary, width int, tokenizer_hash string").coalesce(1).write.parquet(f"{path}/dictionary")

    def compressor():
        return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False).compress

    frames, frames_path = materialise(_raw_ids(docs, doc_id, text, tokenizer, key, end_id, compressor), "frames")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, row, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def cut() -> pa.RecordBatch:
            ids, counts, sizes = [r[0] for r in row], [r[1] for r in row], [len(x) for x in held]
            present = [i for i in ids if i is not None]
            values = [shard, block, first, dict_hash, min(present, default=None), max(present, default=None), ids, np.cumsum([0, *sizes[:-1]]).tolist(), sizes, counts, b"".join(held)]
            return pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, values, strict=True))], BLOCK_SCHEMA)

        for batch in batches:
            for i, n, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                row.append((i, n))
                held.append(frame.as_py())
                size += len(held[-1])
                if size >= BLOCK_BYTES or len(row) >= BLOCK_DOCS:
                    yield cut()
                    block, first, row, held, size = block + 1, first + sum(r[1] for r in row), [], [], 0
        if row:
            yield cut()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = frames.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "frame")
    ordered.mapInArrow(blocks, BLOCK_DDL).write.parquet(f"{path}/blocks")
    drop_path(spark, frames_path)

    made = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks").groupBy("shard").agg(
        F.sum(F.size("doc_ids")).cast("long").alias("n_docs"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_tokens")
    ).orderBy("shard").collect()  # one row a shard
    starts, at = [], 0
    for r in made:
        starts.append((r["shard"], at, r["n_docs"], r["n_tokens"]))
        at += r["n_tokens"]
    spark.createDataFrame(starts, "shard int, start long, n_docs long, n_tokens long").coalesce(1).write.parquet(f"{path}/shards")


BLOCK_DDL = (
    "shard int, block int, first long, dict_hash string, min_id long, max_id long, doc_ids array<long>, offsets array<int>, "
    "lengths array<int>, counts array<long>, data binary"
)
BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("dict_hash", pa.string()), ("min_id", pa.int64()), ("max_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("data", pa.binary()),
])


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids are little-endian unsigned 32-bit numbers (binary).

    start: ids of all documents before it in the files. With doc_ids only their blocks are read and only their
    frames are decompressed. A block whose dictionary hash isn't that of the dictionary there is an error.
    """
    workers_ready(spark)
    head = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, dict_hash, width = bytes(head["dictionary"]), head["dict_hash"], head["width"]
    if hashlib.sha256(dictionary).hexdigest() != dict_hash:
        raise ValueError("the dictionary doesn't have its hash")
    wanted = None if doc_ids is None else set(doc_ids)
    starts = {r["shard"]: r["start"] for r in spark.read.parquet(f"{path}/shards").collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompress
        for batch in batches:
            for k in range(batch.num_rows):
                x = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                if x["dict_hash"] != dict_hash:
                    raise ValueError("a block was made with another dictionary")
                start, data, out = starts[x["shard"]] + x["first"], memoryview(x["data"]), []
                for i, n, at, length in zip(x["doc_ids"], x["counts"], x["offsets"], x["lengths"], strict=True):
                    if wanted is None or i in wanted:
                        raw = unpack(data[at : at + length])
                        out.append((i, start, n, np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                    start += n
                for lo in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out[lo : lo + 256], strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    found = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    if doc_ids is not None:
        near = F.lit(False)
        for i in doc_ids:
            near = near | F.lit(i).between(F.col("min_id"), F.col("max_id"))
        found = found.where(near)
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
