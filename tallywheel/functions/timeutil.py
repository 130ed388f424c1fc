"""UTC calendar and timestamp expressions over unix milliseconds. The session's time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def utc_timestamp(ms: Column) -> Column:
    """Seconds since the epoch, cut towards zero: -1 ms is still 1970-01-01."""
    return F.timestamp_seconds(F.expr("0L") + F.when(ms >= 0, F.floor(ms / 1000)).otherwise(F.ceil(ms / 1000)))


def day(ms: Column) -> Column:
    return F.to_date(utc_timestamp(ms))


def week_start(ms: Column) -> Column:
    """The Monday of the ISO week."""
    return F.to_date(F.date_trunc("WEEK", utc_timestamp(ms)))


def month_start(ms: Column) -> Column:
    return F.to_date(F.date_trunc("MONTH", utc_timestamp(ms)))


PERIODS = {"daily": day, "weekly": week_start, "monthly": month_start}


def rfc3339_millis(text: Column) -> Column:
    """Unix milliseconds of an RFC 3339 timestamp; null for anything else (a bare date, too)."""
    clean = F.regexp_replace(F.regexp_replace(text, "[Tt]", "T"), "[Zz]$", "Z")
    return F.when(text.rlike(_RFC3339), F.unix_millis(clean.try_cast("timestamp")))


def seconds_millis(seconds: Column) -> Column:
    """Milliseconds of positive finite seconds, rounded; null otherwise."""
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds > 0) & (seconds * 1000 <= F.lit(9.2e18))
    return F.when(ok, F.round(seconds * 1000).cast("long"))


def compact_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd-HHmmss")


def utc_text(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss 'UTC'")


def duration_text(ms: Column) -> Column:
    """Xm Ys below an hour, Xh Ym from there; negative durations are zero."""
    seconds = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    minutes = F.floor(seconds / 60)
    short = F.format_string("%dm %ds", minutes, seconds % 60)
    return F.when(minutes < 60, short).otherwise(F.format_string("%dh %dm", F.floor(minutes / 60), minutes % 60))
