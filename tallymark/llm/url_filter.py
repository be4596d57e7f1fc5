"""Operator 9, URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Default of the operator's own interface: (verdict, rule); a rule is a host, a slash and the rest of a path's start.
#: An existing test fixes these words; the query takes the contract's list below.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("allow", "example.net/de/8"),
    ("block", "org/es/"),
]
#: The rules of the query's contract. In `net/de/` and `example.net/de/8` their words are not those of RULES.
CONTRACT_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
TREES, DEPTH = 20, 4
#: Where each feature is cut. The trees see on which side of each cut a URL lies, so no threshold is
#: taken from the rows, and rows alike in all of them are one row with a weight.
CUTS = {
    "f_length": [10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 100, 130, 200, 400],
    "f_depth": [1, 2, 3, 4, 5, 6, 8, 10],
    "f_digits": [0.01, 0.03, 0.05, 0.07, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5],
    "f_entropy": [1, 2, 2.5, 3, 3.25, 3.5, 3.75, 4, 4.125, 4.25, 4.375, 4.5, 4.75, 5, 5.5],
    "f_params": [1, 2, 3, 4, 5, 6, 8, 10],
    "f_suffix_share": [0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97, 0.99],
    "f_suffix_count": [0.5, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16],
}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` with A-Z lower-cased, and path up to `?` or `#`; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. Rules of one length: the greater text wins."""
    parts = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        parts.append(F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(h).alias("h"), F.lit(slash + p).alias("p")))
    fits = F.filter(F.array(*parts), lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]))
    return F.array_max(fits)


def _lexical(df: DataFrame) -> DataFrame:
    """df (with url, host, path) and the features that one URL has by itself."""
    u = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    counts = F.transform(F.array_distinct(F.split(u, "")), lambda c: (F.length(u) - F.length(F.replace(u, c))) / n)
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))
    many = lambda text, chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    return df.select(
        "*", F.length(u).cast("double").alias("f_length"), many(F.col("path"), "/").alias("f_depth"), (many(u, "0123456789") / n).alias("f_digits"),
        entropy.alias("f_entropy"), many(u, "&=").alias("f_params"), F.regexp_extract("host", r"[^.]*$", 0).alias("suffix"),
    )


def _levels() -> list[Column]:
    """Of each feature the number of its cuts that a row reaches."""
    reached = lambda f, cuts: F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: F.col(f) >= c)
    return [F.size(reached(f, cuts)).alias(f) for f, cuts in CUTS.items()]


def _vector() -> Column:
    """A binary feature for each cut, by the features' levels. Named as binary, as Spark would otherwise draw rows to choose thresholds."""
    sides = [(f, k) for f, cuts in CUTS.items() for k in range(len(cuts))]
    meta = {"ml_attr": {"attrs": {"binary": [{"idx": i, "name": f"{f}_{k}"} for i, (f, k) in enumerate(sides)]}, "num_attrs": len(sides)}}
    return array_to_vector(F.array(*[(F.col(f) > k).cast("double") for f, k in sides])).alias("__features", metadata=meta)


class UrlModel:
    """Boosted trees with the suffix table they were trained beside; `constant` where the labels are of one kind."""

    def __init__(self, model, suffixes: DataFrame | None, prior: float, constant: str | None):
        self.model, self.suffixes, self.prior, self.constant = model, suffixes, prior, constant

    def with_suffixes(self, df: DataFrame) -> DataFrame:
        # The table is as long as the list of the suffixes of labelled rows: those of the rules' hosts.
        out = _lexical(df).join(self.suffixes, "suffix", "left")
        return out.withColumns({"f_suffix_share": F.coalesce("s_share", F.lit(self.prior)), "f_suffix_count": F.log1p(F.coalesce("s_rows", F.lit(0)))})

    def verdicts(self, df: DataFrame) -> DataFrame:
        """df with its verdict column in `model_verdict`."""
        if self.constant:
            return df.withColumn("model_verdict", F.lit(self.constant))
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__df")
        rows = self.with_suffixes(df.select(row, "url", "host", "path")).select("__df", *_levels()).select("__df", _vector())
        out = self.model.transform(rows)
        return out.select("__df.*", F.when(F.col("prediction") == 1, F.lit("block")).otherwise(F.lit("allow")).alias("model_verdict"))


def train(labelled: DataFrame) -> UrlModel:
    """Fit on all labelled (url, host, path, label 0 or 1); counts, suffixes and trees are of all rows.

    Rows with the same levels and label are one training row whose weight is their number, which gives the same
    trees as the rows themselves.
    """
    suffix = _lexical(labelled).groupBy("suffix").agg(F.count("*").alias("s_rows"), F.sum("label").alias("s_block"))
    suffix, _ = materialise(suffix, "url-suffixes")
    n, blocked = suffix.agg(F.sum("s_rows"), F.sum("s_block")).first()
    if not n or blocked in (0, n):
        return UrlModel(None, None, 0.0, "block" if blocked else "allow")
    prior = blocked / n
    stats = suffix.select("suffix", "s_rows", ((F.col("s_block") + F.lit(2 * prior)) / (F.col("s_rows") + 2)).alias("s_share"))
    out = UrlModel(None, stats, prior, None)
    kinds = out.with_suffixes(labelled).select("label", *_levels()).groupBy("label", *CUTS).agg(F.count("*").cast("double").alias("weight"))
    kinds, _ = materialise(kinds, "url-kinds")
    booster = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7)
    out.model = booster.fit(kinds.select(_vector(), F.col("label").cast("double").alias("label"), "weight"))
    return out


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    URLs that a rule fits take its verdict and are the labelled rows that the trees learn from; the rest take
    the trees' verdict. A null URL, or one without `://`, has an empty host and path, no rule, and the trees'
    verdict. Where all labelled rows have one verdict, or there are none, the rest take that (none: allow).
    Columns of pages with the new names are replaced; equal rows are judged alike. Empty in, empty out. The
    rules are a short list of parameters: each URL is held against every one.
    """
    cols = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    work = pages.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col(url).alias("url"))
    host, path = host_and_path(F.col("url"))
    work = work.select("__row", "url", host.alias("host"), path.alias("path"))
    work = work.withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    labelled = work.where("__rule is not null").select("url", "host", "path", (F.col("__rule.verdict") == "block").cast("int").alias("label"))
    judged = train(labelled).verdicts(work)
    names = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", "model_verdict")}
    out = judged.select(F.col("__row"), *[c.alias(f"__{n}") for n, c in names.items()])
    return out.select(*[F.col(f"__row.`{c}`") for c in cols], *[F.col(f"__{n}").alias(n) for n in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, CONTRACT_RULES)[["page_id", "host", "path", "rule", "verdict"]]
