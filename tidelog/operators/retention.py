"""Retention in whole UTC days."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import ts_literal, utc

# Fixed value: days kept when nothing usable is configured.
DEFAULT_DAYS = 30


def parse_retention_days(raw: str | None) -> int:
    """Leading integer of the text; anything unusable or below 1 means the default."""
    found = re.match(r"\s*([+-]?[0-9]+)", raw or "")
    days = int(found.group(1)) if found else DEFAULT_DAYS
    return days if days >= 1 else DEFAULT_DAYS


def is_expired(log_date: Column, now: datetime, days: int = DEFAULT_DAYS) -> Column:
    """True when the whole day lies before the window.

    The bound is a literal, so that it prunes partitions.
    """
    return log_date <= F.lit(last_expired_date(now, days))


def last_expired_date(now: datetime, days: int = DEFAULT_DAYS):
    """The newest date D with D + 1 day <= now - days."""
    return (utc(now) - timedelta(days=days)).date() - timedelta(days=1)


def surviving(logs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """Rows left after retention; on a table without partitions the same cut on the time column."""
    first_kept = last_expired_date(now, days) + timedelta(days=1)
    if "log_date" in logs.columns:
        return logs.filter(F.col("log_date") >= F.lit(first_kept))
    return logs.filter(F.col("timestamp") >= ts_literal(datetime(first_kept.year, first_kept.month, first_kept.day)))


def expired_days(logs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """Expired days with the rows they hold."""
    log_date = F.col("log_date") if "log_date" in logs.columns else F.to_date("timestamp")
    return (
        logs.select(log_date.alias("log_date"))
        .filter(is_expired(F.col("log_date"), now, days))
        .groupBy("log_date")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
