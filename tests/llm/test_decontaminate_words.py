"""Template words: each word is judged once, with signs, number words and odd line ends."""

from __future__ import annotations

from tallymark.llm import decontaminate


def test_words_are_judged_once(spark):
    texts = ["ma  \u0085seven\u0085 “twenty-one” SEVEN-two! now Kelvin%", "we paid 5 dollars, five Meters and (Two) x1y. Then Olga left", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hashed = decontaminate._hashed(df, ["id"], "text", True)
    assert hashed._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    got = {r["id"]: [(x["t"], x["v"]) for x in r["tok"]] for r in decontaminate._tokens(df, ["id"], "text", True).collect()}
    assert got[0] == [("ma", None), ("<number>", "seven twenty-one"), ("<name>", "seven-two"), ("now", None), ("<name>", "kelvin%")]
    assert [t for t, _ in got[1]] == ["we", "paid", "<number>", "and", "<number>", "then", "<name>", "left"] and got[2] == []
    assert got[1][2] == ("<number>", "5 five")
