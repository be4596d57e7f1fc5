"""Layers of price lists, resolution through both tables, and rows priced by eras, overrides and billing flags."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallymark import reports
from tallymark.operators import price_book, price_rows, pricing
from tallymark.schema import conform

M = 1e-6


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A snapshot, a live list and a catalogue as JSON files."""
    root = tmp_path_factory.mktemp("prices")
    lists = {
        "snapshot": {"pine": {"i": 2 * M, "o": 4 * M}, "gpt-5": {"i": 9 * M, "o": 9 * M}, "gpt-5.2": {"i": 9 * M, "o": 9 * M}, "glm-4.6": {"i": 3 * M, "o": 5 * M, "cr": 1 * M}, "fir": {"i": 1 * M, "o": 1 * M, "ctx": 64000},
                     "elm-20250101": {"i": 1 * M, "o": 2 * M}, "no-output": {"i": 1 * M}},
        "live": {"fir": {"i": 6 * M, "o": 7 * M, "cc": 8 * M, "cr": 0, "ia": 12 * M, "fast": 3.0}},
        "catalogue": {
            "elm": {"cost": {"input": 50, "output": 60, "tiers": [{"input": 3, "output": 9, "tier": {"type": "context", "size": 128000}}, {"input": 7, "output": 8, "tier": {"type": "context", "size": 256000}}, {"input": 0, "tier": {"type": "day", "size": 5}}]}},
            "maple.1": {"cost": {"input": 1, "output": 2, "cache_read": 0.25}, "exactOnly": True, "limit": {"context": 1000}},
            "nil": {"cost": {"input": 0, "output": 0}},
            "a/yew": {"cost": {"input": 1, "output": 1}}, "b/YEW": {"cost": {"input": 2, "output": 2}}, "ccc/yew": {"cost": {"input": 2, "output": 2}}, "larch-3": {"cost": {"input": 1, "output": 1}},
        },
    }
    for name, data in lists.items():
        (root / f"{name}.json").write_text(json.dumps(data))
    return {n: str(root / f"{n}.json") for n in lists}


@pytest.fixture(scope="module")
def book(spark, files):
    lists = price_book.compact_list(spark, files["snapshot"]), price_book.catalogue_list(spark, files["catalogue"]), price_book.compact_list(spark, files["live"])
    return price_book.book(spark, *lists, overrides={"pine": {"output": 11, "fast_multiplier": 4.0}, "mine": {"input": 4, "output": 8}, "half": {"input": 4}}, user_aliases={"house": "pine"})


def test_layers(spark, book):
    rows = {r["name"]: r for r in book.rows.where("tab = 0").collect()}
    of = lambda name, kind="rate": tuple(None if (v := rows[name][f"{k}_{kind}"]) is None else v / 1e6 for k in pricing.KINDS)
    assert of("pine") == (2, 11, 2.5, 0.2) and rows["pine"]["provenance"] == "snapshot+override" and rows["pine"]["fast_multiplier"] == 4  # derived rates stay those of the list
    assert of("gpt-5") == (9, 9, 11.25, 0.9) and rows["gpt-5"]["provenance"] == "snapshot"  # own rates only fill
    assert of("gpt-5.2") == (1.75, 14, 1.75, 0.175) and rows["gpt-5.2"]["provenance"] == "builtin"  # but some replace
    assert of("glm-4.6") == (3, 5, 0, 1) and rows["glm-4.6"]["provenance"] == "snapshot+builtin" and rows["glm-4.6"]["create_explicit"]  # and some complete
    assert of("fir") == (6, 7, 8, 0) and of("fir", "above") == (12, None, None, None) and rows["fir"]["fast_multiplier"] == 3  # a live list replaces whole rows
    assert of("elm-20250101", "above") == (3, 9, None, None) and rows["elm-20250101"]["threshold"] == 128_000 and rows["elm-20250101"]["provenance"] == "snapshot+catalogue"
    assert of("mine") == (4, 8, 5, 0.4) and not rows["mine"]["read_explicit"] and "half" not in rows and "no-output" not in rows
    assert of("claude-sonnet-4", "above") == (6, 22.5, 7.5, 0.6) and rows["claude-sonnet-4"]["threshold"] is None
    second = {r["name"]: r for r in book.rows.where("tab = 1").collect()}
    assert "nil" not in second and second["maple.1"]["exact_only"] and second["maple.1"]["context"] == 1000 and second["maple.1"]["read_rate"] == 250_000 and second["elm"]["threshold"] == 128_000


def test_resolution_through_two_tables(spark, book):
    names = ["pine", "house", "house-fast", "gpt-5.6", "elm", "maple-1", "maple@1", "MAPLE.1", "PINE", "x/maple.1", "yew", "oak-free", "vendor:pine-20250101", "larch-3-turbo", "larch-35", "larch", "nothing", None]
    got = {r["model"]: (r["tab"], r["name"], r["how"], r["direct"]) for r in price_book.resolve_names(spark.createDataFrame([(n,) for n in names], "model string"), book).collect()}
    assert got == {
        "pine": (0, "pine", "exact", True), "house": (0, "pine", "exact", False), "house-fast": (0, "pine", "fuzzy", False), "gpt-5.6": (0, "gpt-5.6-sol", "exact", False), "elm": (1, "elm", "exact", True),
        "maple-1": (1, "maple.1", "exact", True), "maple@1": (1, "maple.1", "exact", True), "MAPLE.1": (1, "maple.1", "identity", False), "PINE": (0, "pine", "identity", False), "yew": (1, "b/YEW", "consensus", False),
        "oak-free": (None, None, "free", False), "vendor:pine-20250101": (0, "pine", "fuzzy", False), "larch-3-turbo": (1, "larch-3", "fuzzy", False), "larch": (1, "larch-3", "fuzzy", False),
    }
    assert price_book.resolve_names(spark.createDataFrame([], "model string"), book).count() == 0


def test_fast_multiple(spark):
    names = ["anthropic.claude-opus-4-6-v1", "us.anthropic.claude-opus-4-8", "gpt-5.6", "openrouter:gpt-5.5", "claude-opus-4-60", "vendor/claude-opus-4.7", "gpt-5.5-mini", "a/b/gpt-5.4"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", F.coalesce(price_book.fast_multiple(F.col("n")), F.lit(1.0)).alias("m")).collect()
    assert {r["n"]: r["m"] for r in got} == {n: pricing.fast_multiplier(n) for n in names}


NAMES = "seq long, agent string, model string, candidates array<string>, exact_candidates array<string>, override_candidates array<string>, ts_ms long, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, extra_tokens long, first_found boolean, extra_as_output boolean, create_as_input boolean, ignores_time boolean, recorded_zero boolean, cost_usd double"
LATE = 1_786_896_000_000 + 3 * 86_400_000  # a Wednesday, 16:00 UTC: off-peak of the second era


def row(seq, model=None, candidates=None, counts=(10, 10, 0, 0, 0), agent="x", ts=LATE, exact=None, over=None, **flags):
    return (seq, agent, model, candidates, exact, over, ts, *counts, *[flags.get(f) for f in ("first_found", "extra_as_output", "create_as_input", "ignores_time", "recorded_zero", "cost_usd")])


def costs(spark, rows, *a, **kw):
    df = price_rows.price(spark.createDataFrame(rows, NAMES), *a, **kw)
    return {r["seq"]: (r["cost_pico"] / 1e6, r["missing_pricing"]) for r in df.collect()}


def test_overrides_hold_in_every_era(spark):
    rows = [row(1, "deepseek-v4-pro"), row(2, "deepseek-v4-pro", ts=LATE + 10 * 3_600_000), row(3, "deepseek.v4@pro"), row(4, "deepseek-v4-flash"), row(5, "deepseek-v4-pro", counts=(0, 0, 10, 10, 0))]
    usage = spark.createDataFrame(rows, NAMES)
    plain = {r["seq"]: r["cost_pico"] for r in reports.price(usage, mode="calculate").collect()}
    assert plain[1] == 26_400_000 and plain[2] == 52_800_000 and plain[3] == plain[1]
    own = {r["seq"]: r["cost_pico"] for r in reports.price(usage, mode="calculate", overrides={"deepseek-v4-pro": {"input": 100, "output": 100}}).collect()}
    assert own == {1: 2_000_000_000, 2: 2_000_000_000, 3: 2_000_000_000, 4: plain[4], 5: plain[5]}


def test_rows(spark, book):
    rows = [
        row(1, "deepseek-v4-pro", ignores_time=True), row(2, "deepseek-v4-pro", ts=None), row(3, "pine", counts=(1, 0, 0, 0, 5), extra_as_output=True), row(4, "pine", counts=(1, 0, 5, 0, 0), create_as_input=True),
        row(5, "x", ["zai/glm-4.5-flash", "fir"]), row(6, "x", ["zai/glm-4.5-flash", "fir"], first_found=True), row(7, "who", ["who"]), row(8, "who", ["who"], recorded_zero=True), row(9, None, ["who"]),
        row(10, "x", ["fir"], exact=["missing", "elm", "house"]), row(11, "x", ["fir"], over=["elm", "mine"]), row(12, "x", ["fir"], over=["elm"]), row(13, "who", cost_usd=0.5), row(14, "half", cost_usd=None),
        row(15, "elm-20250101", counts=(128_001, 1, 0, 0, 0)), row(16, "elm-20250101", counts=(128_000, 0, 0, 0, 0)), row(17, "elm-20250101", counts=(100_000, 0, 0, 28_001, 0), agent="codex"), row(18, None),
        row(19, "oak-free"), row(20, "mine", counts=(0, 0, 0, 10, 0), agent="codex"),
    ]
    want = {
        1: (0.435 * 10 + 0.87 * 10, False), 2: (0.435 * 10 + 0.87 * 10, False), 3: (2 + 55, False), 4: (12, False), 5: (130, False), 6: (0, False), 7: (0, True), 8: (0, False), 9: (0, False),
        10: (1100, False), 11: (120, False), 12: (130, False), 13: (500_000, False), 14: (0, True), 15: (128_001 * 3 + 9, False), 16: (128_000, False), 17: (100_000 * 3 + 28_001 * 3, False), 18: (0, False),
        19: (0, False), 20: (40, False),
    }
    # 17, 20: a read rate that is only derived counts as input, at 17 beyond the threshold of the catalogue.
    got = costs(spark, rows, book, mode="auto")
    assert {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == got
    assert costs(spark, rows, book, mode="auto", broadcast_lists=0) == got
    assert costs(spark, rows[12:14], book, mode="display") == {13: (500_000, False), 14: (0, False)}
    assert price_rows.price(spark.createDataFrame([], NAMES), book).count() == 0
    assert set(conform(spark.createDataFrame(rows, NAMES)).columns) >= {"one_hour", "candidates"}
