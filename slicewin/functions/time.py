"""Timestamps as milliseconds since 1970 and back."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(at: Column, kind: str) -> Column:
    """Whole milliseconds, rounded down; a timestamp without zone and a date count as of UTC, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_millis(at)
    days = F.unix_date(at.cast("date")).cast("long") * 86_400_000
    if kind == "date":
        return days
    seconds = F.floor(F.extract(F.lit("SECONDS"), at) * 1000).cast("long")
    return days + F.hour(at).cast("long") * 3_600_000 + F.minute(at).cast("long") * 60_000 + seconds


def at_millis(ms: int, kind: str) -> Column:
    """The literal of that type which is ``ms`` milliseconds after 1970."""
    if kind == "timestamp":
        return F.timestamp_millis(F.lit(ms))
    at = datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)
    return F.expr(f"TIMESTAMP_NTZ '{at:%Y-%m-%d %H:%M:%S.%f}'")
