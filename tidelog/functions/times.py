"""Timestamps as text, and time buckets. All of it in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket names and their lengths.
BUCKETS = {
    "1m": timedelta(minutes=1),
    "5m": timedelta(minutes=5),
    "1h": timedelta(hours=1),
    "1d": timedelta(days=1),
}

_TRUNC_UNIT = {"1m": "minute", "1h": "hour", "1d": "day"}


def iso_micros(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def bucket_start(ts: Column, bucket: str) -> Column:
    """Start of the bucket ``ts`` falls into; floors, also before 1970."""
    if bucket in _TRUNC_UNIT:
        return F.date_trunc(_TRUNC_UNIT[bucket], ts)
    if bucket == "5m":
        seconds = F.unix_seconds(ts)
        step = F.lit(int(BUCKETS[bucket].total_seconds()))
        return F.timestamp_seconds(seconds - F.pmod(seconds, step))
    raise ValueError(f"unknown bucket {bucket!r}")


def utc(value: datetime) -> datetime:
    """A naive datetime is read as UTC."""
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)


def ts_literal(value: datetime) -> Column:
    return F.lit(utc(value))
