"""Time handling: bounds, literals and text formats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Export time format, and the text of Go's zero time (a
# timestamp that was never set).
EXPORT_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
ZERO_TIME_TEXT = "0001-01-01 00:00:00"
# RFC3339 with microseconds, UTC designator, for heartbeat messages we emit.
RFC3339_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def to_datetime(value) -> dt.datetime:
    """Parse a bound given as datetime / date / ISO text into a naive UTC
    datetime (aware values are converted to UTC)."""
    if isinstance(value, dt.datetime):
        out = value
    elif isinstance(value, dt.date):
        out = dt.datetime(value.year, value.month, value.day)
    else:
        text = str(value).strip().replace("Z", "+00:00")
        out = dt.datetime.fromisoformat(text)
    if out.tzinfo is not None:
        out = out.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return out


def second_floor(value) -> dt.datetime:
    """Report bounds travel as RFC3339 without fraction: whole seconds."""
    return to_datetime(value).replace(microsecond=0)


def ts_literal(value, like: T.DataType | None = None) -> Column:
    """A timestamp literal of the same type as the column it is compared
    with, so the comparison stays a plain pushed-down Parquet filter."""
    text = to_datetime(value).isoformat(sep=" ")
    target = "timestamp" if isinstance(like, T.TimestampType) else "timestamp_ntz"
    return F.lit(text).cast(target)


def format_time(c) -> Column:
    """``yyyy-MM-dd HH:mm:ss``; a never-set (NULL) time prints as Go's zero time."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.date_format(col, EXPORT_TIME_FORMAT), F.lit(ZERO_TIME_TEXT))


def to_utc_ntz(c) -> Column:
    """TIMESTAMP (instant) -> TIMESTAMP_NTZ wall clock; the session is UTC."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("timestamp_ntz")


def rfc3339_text(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, RFC3339_MICROS)
