"""Token-counter normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero(x: Column) -> Column:
    return F.coalesce(x.cast("long"), F.lit(0).cast("long"))


def lenient_uint(x: Column) -> Column:
    """Whole non-negative part of a number or numeric text; anything else is 0."""
    v = x.cast("string").try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), F.floor(v)).otherwise(F.lit(0)).cast("long")


def strict_uint(x: Column) -> Column:
    """A whole non-negative number, else null."""
    v = x.cast("string").try_cast("double")
    return F.when((v >= 0) & (v == F.floor(v)), v.cast("long"))


def without_cached(total: Column, cached: Column) -> Column:
    """Tokens that weren't read from the cache: never negative, however large the cached part claims to be."""
    return F.greatest(zero(total) - zero(cached), F.lit(0).cast("long"))


def explained(total: Column, inp: Column, out: Column, created: Column, read: Column) -> tuple[Column, Column]:
    """(output, extra) once a reported total is explained: what is missing is output if there is none, else extra."""
    rest = F.greatest(zero(total) - (zero(inp) + zero(out) + zero(created) + zero(read)), F.lit(0).cast("long"))
    none = zero(out) == 0
    return F.when(none, rest).otherwise(zero(out)), F.when(none, F.lit(0).cast("long")).otherwise(rest)


def first_nonzero(*cols: Column) -> Column:
    """The first argument that is neither null nor 0, else 0."""
    return F.coalesce(*[F.nullif(c.cast("long"), F.lit(0).cast("long")) for c in cols], F.lit(0).cast("long"))
