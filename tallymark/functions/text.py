"""Text helpers for model names, paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(x: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(x), F.lit(""))


def pricing_key(x: Column) -> Column:
    """A model name with `.` and `@` as `-`."""
    return F.translate(x, ".@", "--")


def model_identity(x: Column) -> Column:
    return pricing_key(F.lower(x))


def without_date(x: Column) -> Column:
    """A model name without a date at its end."""
    return F.when(F.length(x) > 9, F.regexp_replace(x, r"(?<=.)-(\d{4}-\d{2}-\d{2}|\d{8})$", "")).otherwise(x)


def is_free(x: Column) -> Column:
    """Whether the last part of a model name ends in -free or :free."""
    return F.element_at(F.split(x, "/"), -1).rlike("(?i)[-:]free$")


def short_model(x: Column) -> Column:
    """A model name for people: no provider, no `claude-`, no date at the end."""
    return without_date(F.regexp_replace(F.element_at(F.split(x, "/"), -1), "^claude-", ""))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def part(path: Column, from_end: int) -> Column:
    """A part of a path counted from its end: 1 is the file name. Null where the path is shorter."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= from_end, F.element_at(parts, -from_end))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def percent_decoded(x: Column) -> Column:
    """Percent-decoded text; a malformed one stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)
