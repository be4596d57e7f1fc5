"""Scans of log files: a listing of files with their time and size, whole files, and numbered lines read by byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import percent_decoded
from ..scratch import written
from ..shipping import python_ready
from . import ranges

#: Bytes of a file that one call reads; a file of more is read by several tasks.
STEP = 16 << 20


def _path() -> Column:
    return percent_decoded(F.regexp_replace("_metadata.file_path", "^file:(//)?", ""))


def listing(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_file, mtime_ms, size): every file under root whose name fits the glob; no file is opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return df.select(_path().alias("source_file"), F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"), F.col("_metadata.file_size").alias("size"))


def whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_file, value, mtime_ms): every file under root whose name fits the glob, as one text."""
    df = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return df.select(_path().alias("source_file"), "value", F.unix_millis("_metadata.file_modification_time").alias("mtime_ms"))


def _spread(parts: DataFrame) -> DataFrame:
    """Ranges over as many tasks as the session has room for, however few files list them."""
    spark = parts.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return parts.repartition(n, "source_file", "start")


def lines(
    spark: SparkSession, root: str, glob: str, markers: list[str] | None = None, files: DataFrame | None = None, step: int = STEP,
) -> DataFrame:
    """(source_file, seq, value, mtime_ms): the lines that hold one of the markers; seq is the line's number from 0.

    Files are read in ranges of `step` bytes. A line belongs to the range in which it begins, so each is read once and whole,
    however long. Of files of several ranges the line breaks are counted first and summed over the ranges before. `files`
    stands for the listing where only some files are wanted; others aren't opened. Lines end at line feeds; bytes that aren't
    UTF-8 become replacement characters. Empty files have no lines.
    """
    files = listing(spark, root, glob) if files is None else files
    return lines_from(files.withColumns({"begin": _long(0), "before": _long(0)}), markers, step)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _parts(files: DataFrame, step: int) -> DataFrame:
    starts = F.explode(F.sequence("begin", F.col("size") - 1, _long(step)))
    return files.where("size > begin").select("source_file", "mtime_ms", "size", "begin", "before", starts.alias("start"))


def lines_from(files: DataFrame, markers: list[str] | None = None, step: int = STEP) -> DataFrame:
    """`lines` of files (source_file, mtime_ms, size, begin, before) from the byte `begin` on, where a line begins; `before` lines precede it."""
    python_ready(files.sparkSession)
    parts = _parts(files, step)
    counted = _spread(parts.where(F.col("size") - F.col("begin") > step)).mapInArrow(ranges.counter(step), ranges.COUNTED)
    earlier = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("source_file", "start", F.sum("n").over(earlier).alias("first"))
    numbered = parts.join(first, ["source_file", "start"], "left").withColumn("first", F.col("before") + F.coalesce("first", _long(0)))
    return _spread(numbered).mapInArrow(ranges.reader(step, markers or []), ranges.LINES)


def appended(files: DataFrame, known: DataFrame | None = None, markers: list[str] | None = None, step: int = STEP) -> tuple[DataFrame, DataFrame]:
    """The lines that the files of a listing gained since the state `known`, and the state after them, both as tables to be written.

    The state holds (source_file, done, n): the bytes up to the end of the last whole line, and the lines in them. A line
    without a line feed waits for it. A file that is shorter than its state was replaced and is read anew; one that isn't listed
    keeps its state. How far files reach is written down first, so lines and state agree however much files grow meanwhile.
    """
    spark = files.sparkSession
    python_ready(spark)
    known = spark.createDataFrame([], "source_file string, done long, n long") if known is None else known
    same = F.col("done") <= F.col("size")
    at = lambda c: F.coalesce(F.when(same, F.col(c)), _long(0))
    grown = files.join(known, "source_file", "left").select("source_file", "mtime_ms", "size", at("done").alias("start"), at("n").alias("before")).where("size > start")
    reach, _ = written(_spread(grown).mapInArrow(ranges.whole_lines, ranges.REACH), "log-reach")
    n = _spread(_parts(reach, step)).mapInArrow(ranges.counter(step), ranges.COUNTED).groupBy("source_file").agg(F.sum("n").alias("more"))
    moved = reach.join(n, "source_file", "left").select("source_file", F.col("size").alias("done"), (F.col("before") + F.coalesce("more", _long(0))).alias("n"))
    state = known.select("source_file", "done", "n").join(moved, "source_file", "left_anti").unionByName(moved)
    return lines_from(reach, markers, step), state


def first_lines(files: DataFrame) -> DataFrame:
    """(source_file, seq, value, mtime_ms): the first line of each file of a listing, of which nothing more is read."""
    python_ready(files.sparkSession)
    parts = files.where("size > 0").select("source_file", "mtime_ms", "size", F.lit(0).cast("long").alias("start"))
    return _spread(parts).mapInArrow(ranges.heads, ranges.LINES)


def parsed(df: DataFrame, ddl: str) -> DataFrame:
    """df with its JSON text as the struct `j` of an explicit schema; texts that aren't JSON objects are dropped.

    Fields declared as string take any scalar as its text; a value of another shape than declared is null.
    """
    return df.withColumn("j", F.from_json("value", ddl, {"mode": "PERMISSIVE"})).where(F.col("j").isNotNull() & F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) is not null"))
