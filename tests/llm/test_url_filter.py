"""The URL filter's query by its contract, and its trees by all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.llm import url_filter
from tallymark.llm.queries import QUERIES


def test_query_has_the_words_of_the_contract(spark, tmp_path):
    urls = ["http://a.com/en/5", "http://q.example.com/en/712", "http://a.net/de/8", "http://q.example.net/de/81", "http://q.example.net/de/7", "http://z.org/es/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["rule"], r["verdict"]) for r in QUERIES["op9_url_filter"](spark, str(tmp_path)).orderBy("page_id").collect()]
    want = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    assert got == want


def test_trees_learn_from_every_row(spark):
    """One labelled row in fifty tells that paths of many levels are allowed; over 20,000 rows of a label were sampled before."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 50 == 0, F.concat(F.lit("http://w.com/a/b/c/d/e/f/g/"), "id")).otherwise(F.concat(F.lit("http://w.com/"), "id")).alias("url"), (F.col("id") % 50 != 0).cast("int").alias("label"))
    host, path = url_filter.host_and_path(F.col("url"))
    model = url_filter.train(rows.withColumns({"host": host, "path": path}))
    assert [tuple(r) for r in model.suffixes.select("suffix", "s_rows").collect()] == [("com", 40_000)] and model.prior == 0.98
    asked = spark.createDataFrame([("http://w.com/a/b/c/d/e/f/g/1", "w.com", "/a/b/c/d/e/f/g/1"), ("http://w.com/1", "w.com", "/1")], "url string, host string, path string")
    assert [r["model_verdict"] for r in model.verdicts(asked).collect()] == ["allow", "block"]
