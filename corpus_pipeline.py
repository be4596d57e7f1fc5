"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from tallymark.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents without a recognisable language (no text, or no letter) go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.identify(docs.select(*COLUMNS), model)
    return judged.where(F.col("lang_pred") != "und").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: lines on too large a share of their site's pages go; n_chars follows the text."""
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component of linked documents the one with the least doc_id stays.

    Rows of one doc_id are one document and stay or go together. Texts without words and rows without a doc_id stay.
    """
    found = jaccard_join.jaccard_join(docs)
    go = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a benchmark item, also with other numbers or names, go.

    Null and empty texts stay. Rows of one doc_id with other texts are judged each, rows without a doc_id too. Without items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, items).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token ids of each document, with the digests of the ids and of the bytes they decode to. A null text is empty; each row has its own."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("byte_bpe", encode),
]

#: SQL can express neither the learned language model nor byte-pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; between stages the rows stand in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
