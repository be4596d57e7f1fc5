"""Which files of a listing must be read for a report from a day on: joins over file times, before any line is read."""

from __future__ import annotations

import datetime
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A day may begin 14 hours before the UTC day of its name; file times may lag behind their last row by a day.
ZONE_MS, LAG_MS = 14 * 3_600_000, 24 * 3_600_000


def threshold(since: str | None, now_ms: int | None = None) -> int | None:
    """The file time from which files matter to a report since a day (`YYYYMMDD` or with dashes); None: all matter.

    A day that no zone has reached yet tells nothing of files, so all matter.
    """
    if not since:
        return None
    day = datetime.datetime.strptime(since.replace("-", ""), "%Y%m%d").replace(tzinfo=datetime.UTC)
    begins = int(day.timestamp() * 1000) - ZONE_MS
    now = int(time.time() * 1000) if now_ms is None else now_ms
    return None if begins > now else begins - LAG_MS


def recent_groups(files: DataFrame, group: Column, since_ms: int | None) -> DataFrame:
    """All files of groups of which one file at least is as late as since_ms: a session is read whole or not at all.

    Files without a time are late, files without a group are a group; without since_ms all files stay.
    """
    if since_ms is None:
        return files
    late = files.where(F.coalesce(F.col("mtime_ms") >= since_ms, F.lit(True))).select(group.alias("__late")).distinct()
    return files.withColumn("__group", group).join(late, F.col("__group").eqNullSafe(F.col("__late")), "left_semi").drop("__group")


def with_parents(files: DataFrame, lineage: DataFrame, since_ms: int | None) -> DataFrame:
    """Files of a lineage (source_file, parent_file) as late as since_ms, and the direct parents of those, not theirs.

    Files that the lineage doesn't hold (second copies of another) go; files without a time are late.
    """
    known = files.join(lineage.select("source_file"), "source_file", "left_semi")
    if since_ms is None:
        return known
    late = known.where(F.coalesce(F.col("mtime_ms") >= since_ms, F.lit(True))).select("source_file")
    parents = lineage.join(late, "source_file", "left_semi").where("parent_file is not null").select(F.col("parent_file").alias("source_file"))
    return known.join(late.union(parents).distinct(), "source_file", "left_semi")
