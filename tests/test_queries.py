"""Every usage query against its DuckDB counterpart, and the rules that SQL doesn't show."""

from __future__ import annotations

import importlib.util

import oracle
import pytest
from pyspark.sql import functions as F

from tallymark.functions import dates, text, tokens
from tallymark.operators import blocks, dedup, joins, pricing, resolve
from tallymark.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, name):
    assert oracle.difference(QUERIES[name](spark, sf), ORACLE_SQL[name], oracle.connect(sf)) is None


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert {"period", "cost", "total_tokens"} <= set(df.columns) and df.count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.HAS_LLM == (importlib.util.find_spec("tallymark.llm") is not None)


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_dates(spark):
    ms = F.lit(1_704_078_000_000)  # 2024-01-01 03:00 UTC, a Monday
    assert one(spark, dates.date_key(ms), dates.date_key(ms, "America/New_York")) == ("2024-01-01", "2023-12-31")
    assert one(spark, dates.week_start(F.lit("2024-01-01"), 0), dates.week_start(F.lit("2024-01-01"), 1), dates.month_key(F.lit("2024-01-01"))) == ("2023-12-31", "2024-01-01", "2024-01")
    assert one(spark, dates.strict_millis(F.lit("2024-01-01T03:00:00Z")), dates.strict_millis(F.lit("2024-01-01T03:00:00.5Z")), dates.strict_millis(F.lit("2024-01-01T04:00:00+01:00"))) == (1_704_078_000_000, None, 1_704_078_000_000)
    assert one(spark, dates.round_half_up(F.lit(-2.5)), dates.round_half_up(F.lit(2.5))) == (-2, 3)
    assert one(spark, *[dates.guess_millis(F.lit(v)) for v in (1.7e9, 1.7e12, 1.7e15, 1.7e18)]) == (1_700_000_000_000,) * 4


def test_tokens_and_text(spark):
    out, extra = tokens.explained(F.lit(20), F.lit(5), F.lit(0), F.lit(1), F.lit(2))
    assert one(spark, out, extra) == (12, 0)
    out, extra = tokens.explained(F.lit(20), F.lit(5), F.lit(4), F.lit(1), F.lit(2))
    assert one(spark, out, extra) == (4, 8)
    assert one(spark, tokens.lenient_uint(F.lit("3.9")), tokens.lenient_uint(F.lit("-1")), tokens.lenient_uint(F.lit("x")), tokens.strict_uint(F.lit("1.5"))) == (3, 0, 0, None)
    assert one(spark, text.is_free(F.lit("a/b-free")), text.is_free(F.lit("v/m:free")), text.is_free(F.lit("freebird-1"))) == (True, True, False)
    assert one(spark, text.without_date(F.lit("m-2024-01-02")), text.without_date(F.lit("m-x-20240102")), text.percent_decoded(F.lit("a%20b")), text.percent_decoded(F.lit("a%2"))) == ("m", "m-x", "a b", "a%2")


def rates(spark):
    """Two providers agree on alder-7, a third asks less; birch only as a dearer variant; cedar-free is sold in spite of its name."""
    listed = {"north/alder-7": (2, 8, 0, 0.5), "east/lumber/alder-7": (2, 8, 0, 0.5), "w/alder-7": (1, 3, 0, 0.1), "north/alder-7-long": (40, 90, 0, 4), "birch-2-grand": (7, 7, 0, 0.7),
              "south/birch-2": (0.6, 3, 0, 0.1), "cedar-free": (5, 5, 0, 0.5), "claude-opus-4": (15, 75, 18.75, 1.5)}
    return pricing.rate_table(spark, pricing.rate_rows(listed, {}))


def test_resolution(spark):
    names = ["alder-7", "cedar-free", "oak-free", "vendor/claude-opus-4-20250514", "claude-opus-4-5", "nothing-like-it", "CEDAR@FREE"]
    got = {r["model"]: (r["price_model"], r["how"]) for r in resolve.resolve(spark.createDataFrame([(n,) for n in names], "model string"), rates(spark)).collect()}
    assert got["alder-7"] == ("north/alder-7", "consensus") and got["cedar-free"] == ("cedar-free", "exact")
    assert got["oak-free"] == (None, "free") and got["vendor/claude-opus-4-20250514"] == ("claude-opus-4", "fuzzy")
    assert got["claude-opus-4-5"] == (None, None) and got["nothing-like-it"] == (None, None) and got["CEDAR@FREE"][1] == "identity"


def test_candidates(spark):
    rows = spark.createDataFrame([(1, ["birch-2", "south/birch-2"]), (2, ["none"])], "id long, candidates array<string>")
    rows = rows.withColumns({c: F.lit(n).cast("long") for c, n in (("input_tokens", 1_000_000), ("output_tokens", 0), ("cache_creation_tokens", 0), ("cache_read_tokens", 0))})
    got = pricing.best_candidate(rows, rates(spark), ["id"]).collect()
    assert [(r["id"], r["price_model"], r["cost_pico"]) for r in got] == [(1, "south/birch-2", 600_000_000_000)]


def test_blocks_boundaries(spark):
    h = 3_600_000
    times = [0, 5 * h, 5 * h + 1, 20 * h, 20 * h + 10]  # the request at exactly five hours still belongs to the first block
    rows = spark.createDataFrame([("a", t, i, f"m{i % 2}", 1, 1, 0, 0, 10, None) for i, t in enumerate(times)], "acct string, ts_ms long, seq long, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost_pico long, reset_ms long")
    got = blocks.blocks(rows, ["acct"], now_ms=20 * h + 20).orderBy("start_ms").collect()
    assert [(r["start_ms"] // h, r["is_gap"], r["n_entries"], r["is_active"]) for r in got] == [(0, False, 2, False), (5, False, 1, False), (10, True, 0, False), (20, False, 2, True)]
    assert got[0]["models"] == ["m0", "m1"]
    assert blocks.blocks(rows.where("false"), ["acct"]).count() == 0


def test_active_path(spark):
    rows = [("f", "a", None, 1), ("f", "b", "a", 2), ("f", "c", "a", 3), ("f", "d", "c", 4), ("g", "x", "missing", 1), ("g", "y", "x", 2)]
    got = joins.active_path(spark.createDataFrame(rows, "source_file string, id string, parent_id string, seq long")).collect()
    assert sorted((r["source_file"], r["id"]) for r in got) == [("f", "a"), ("f", "c"), ("f", "d"), ("g", "x"), ("g", "y")]


def test_active_path_long_and_broken_trees(spark):
    chain = [("long", f"n{i}", f"n{i - 1}" if i else None, i) for i in range(5000)] + [("long", "side", "n7", -1)]
    broken = [("cycle", "a", "b", 1), ("cycle", "b", "a", 2), ("cycle", "c", None, 3), ("twice", "a", None, 1), ("twice", "a", None, 2), ("blank", None, None, 1), ("blank", "z", None, 2)]
    rows = spark.createDataFrame(chain + broken + [("two", "a", None, 1), ("two", "b", None, 2)], "source_file string, id string, parent_id string, seq long")
    got = joins.active_path(rows).groupBy("source_file").count().collect()
    assert {r["source_file"]: r["count"] for r in got} == {"long": 5000, "cycle": 3, "twice": 2, "blank": 2, "two": 1}
    assert joins.active_path(rows.where("false")).count() == 0


def test_dedup_keeps_rows_without_key(spark):
    rows = spark.createDataFrame([(1, "k"), (2, "k"), (3, None), (4, None)], "seq long, k string")
    assert sorted(r["seq"] for r in dedup.keep_best(rows, ["k"], [F.col("seq")], F.col("k").isNotNull()).collect()) == [2, 3, 4]
    assert sorted(r["seq"] for r in dedup.first_by(rows, ["k"], ["seq"], F.col("k").isNotNull()).collect()) == [1, 3, 4]


def test_components_cover_every_row(spark):
    folder = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).collect()
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in events:
        a, b = top(f"u{r['user_id']}"), top(f"k{r['user_id'] % 25}-{r['k'] // 90}")
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in QUERIES["dedup_components"](spark, folder).collect()}
    assert got == {x: top(x) for x in root} and len(got) == 200


def test_components_raise_when_unsettled(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert {r["root"] for r in dedup.components(path, "a", "b").collect()} == {0}
    with pytest.raises(RuntimeError):
        dedup.components(path, "a", "b", rounds=1)


def test_fast_multiplier():
    from tallymark.operators.pricing import fast_multiplier

    want = {
        "anthropic.claude-opus-4-6-v1": 6.0, "us.anthropic.claude-opus-4-8": 2.0, "gpt-5.6": 2.0, "openrouter:gpt-5.5": 2.5, "claude-opus-4-60": 1.0,
        "vendor/claude-opus-4.7": 6.0, "gpt-5.5-mini": 1.0,
    }
    assert {name: fast_multiplier(name) for name in want} == want
