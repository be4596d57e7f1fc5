"""Date keys and timestamps as column expressions; time is held in epoch milliseconds."""

from __future__ import annotations

import bisect
import datetime
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def local_time(ts_ms: Column, zone: str = "UTC") -> Column:
    """Wall-clock time (timestamp_ntz) in a zone, whatever the session's zone is."""
    ntz = F.timestamp_millis(ts_ms).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit(zone), ntz)


def date_key(ts_ms: Column, zone: str = "UTC") -> Column:
    """`YYYY-MM-DD` of an instant in a zone."""
    return local_time(ts_ms, zone).cast("date").cast("string")


def day_start_ms(day: str, zone: str = "UTC", plus: int = 0) -> int:
    """The first instant (epoch ms) at which a zone's date is a day (`YYYYMMDD` or with dashes) or later; `plus` days on.

    Where clocks skip midnight it is the moment they do, where midnight comes twice the first, and of a day that a zone left
    out the begin of the next. Unknown zones and days that aren't dates raise a ValueError.
    """
    try:
        at = zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, IsADirectoryError):
        raise ValueError(f"unknown time zone: {zone}") from None
    wanted = datetime.datetime.strptime(day.replace("-", ""), "%Y%m%d").date() + datetime.timedelta(days=plus)
    around = (wanted - datetime.date(1970, 1, 1)).days * 24 * HOUR_MS
    begin = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
    local = lambda ms: (begin + datetime.timedelta(milliseconds=ms)).astimezone(at).date()
    span = range(around - 36 * HOUR_MS, around + 36 * HOUR_MS)
    return span[bisect.bisect_left(span, wanted, key=local)]


def week_start(date: Column, first_day: int = 0) -> Column:
    """First day of a date's week; 0: weeks begin on Sunday, 1: on Monday, and so on."""
    d = date.cast("date")
    return F.date_sub(d, F.pmod(F.dayofweek(d) - 1 - first_day, F.lit(7)).cast("int")).cast("string")


def month_key(date: Column) -> Column:
    return F.substring(date, 1, 7)


def bucket(date: Column, period: str, first_day: int = 0) -> Column:
    """Date key as the key of its period: daily, weekly or monthly."""
    return {"daily": lambda: date, "weekly": lambda: week_start(date, first_day), "monthly": lambda: month_key(date)}[period]()


def strict_millis(text: Column) -> Column:
    """Epoch ms of an RFC 3339 text of exactly these shapes: seconds or 3-digit fraction, `Z` or an offset. Else null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})$"
    return F.when(text.rlike(shape), F.unix_millis(F.try_to_timestamp(text)))


def lenient_millis(text: Column) -> Column:
    """Epoch ms of any ISO-like text; texts without a zone count as UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_millis(F.try_to_timestamp(zoned))


def guess_millis(value: Column) -> Column:
    """Epoch ms of a number of seconds, ms, microseconds or nanoseconds, told apart by size."""
    v = value.cast("double")
    return (
        F.when(v >= 1e17, F.floor(v / 1e6)).when(v >= 1e14, F.floor(v / 1e3)).when(v >= 1e11, F.floor(v)).when(v > 0, F.floor(v * 1e3)).cast("long")
    )


def hour_floor(ts_ms: Column) -> Column:
    return ts_ms - F.pmod(ts_ms, F.lit(HOUR_MS))


def round_half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")
