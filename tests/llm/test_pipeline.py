"""The pipeline's stages keep what they should, and the entry registers every corpus query."""

from __future__ import annotations

import __spark_entry__
import oracle
import pytest

import corpus_pipeline


def test_entry_lists_the_operators():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert 0.9 * before < docs.count() <= before


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r["doc_id"] for r in out]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
    assert all(r["n_tokens"] > 0 and len(r["ids_sha256"]) == 64 for r in out)


@pytest.mark.parametrize("name", ["op2_jaccard_join", "op5_line_dedup", "op7_quality_rules"])
def test_oracle(spark, sf, name):
    assert oracle.difference(__spark_entry__.queries()[name](spark, sf), __spark_entry__.oracle_sql()[name], oracle.connect(sf)) is None
