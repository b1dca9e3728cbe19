"""Counts per time bucket, from the log or from the minute rollup."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import bucket_start, iso_millis, utc
from tidelog.operators.filters import LogFilter, time_conditions

GROUPS = ("service", "level")
MINUTE = timedelta(minutes=1)


def _bucketed(
    rows: DataFrame, time_column: str, bucket: str, group_by: str | None, measure: Column
) -> DataFrame:
    if group_by is not None and group_by not in GROUPS:
        raise ValueError(f"unknown group {group_by!r}")
    start = bucket_start(F.col(time_column), bucket).alias("start")
    keys = [start] if group_by is None else [start, F.col(group_by).alias("group")]
    counted = rows.groupBy(*keys).agg(measure.cast("bigint").alias("count"))
    if group_by is None:
        counted = counted.withColumn("group", F.lit(None).cast("string"))
    return counted.select("start", "group", "count")


def in_order(buckets: DataFrame) -> DataFrame:
    """By bucket, then group. Empty buckets do not appear."""
    return buckets.orderBy("start", F.col("group").asc_nulls_first())


def from_logs(logs: DataFrame, where: LogFilter, bucket: str, group_by: str | None = None) -> DataFrame:
    """Exact counts over the filtered log."""
    return _bucketed(where.apply(logs), "timestamp", bucket, group_by, F.count(F.lit(1)))


def from_rollup(rollup: DataFrame, where: LogFilter, bucket: str, group_by: str | None = None) -> DataFrame:
    """Sums over the rollup. The minutes of both bounds count whole.

    Deltas need no merging first: the sum over them is the same.
    """
    if not rollup_answers(where):
        raise ValueError("the rollup holds neither messages nor attributes")
    since = floor_minute(where.since) if where.since is not None else None
    rows = rollup
    for condition in time_conditions(rollup, since, where.until, "time_bucket", "bucket_date"):
        rows = rows.filter(condition)
    if where.service:
        rows = rows.filter(F.col("service") == where.service)
    if where.level:
        rows = rows.filter(F.col("level") == where.level)
    return _bucketed(rows, "time_bucket", bucket, group_by, F.sum("log_count"))


def rollup_answers(where: LogFilter) -> bool:
    return not where.q and not where.attrs and where.cursor is None


def aggregate(
    logs: DataFrame,
    rollup: DataFrame,
    where: LogFilter,
    bucket: str,
    group_by: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """The rollup where it can answer, else the log.

    The rollup counts the minutes of the bounds whole. ``exact=True`` takes only
    whole minutes from it, and the remainders at both ends from the log.
    """
    if not rollup_answers(where):
        return in_order(from_logs(logs, where, bucket, group_by))
    if not exact:
        return in_order(from_rollup(rollup, where, bucket, group_by))
    return in_order(_exact(logs, rollup, where, bucket, group_by))


def _exact(
    logs: DataFrame, rollup: DataFrame, where: LogFilter, bucket: str, group_by: str | None
) -> DataFrame:
    if where.since is None or where.until is None:
        raise ValueError("exact counts need since and until")
    since, until = utc(where.since), utc(where.until)
    inner_since, inner_until = ceil_minute(since), floor_minute(until)
    if inner_since >= inner_until:
        return from_logs(logs, where, bucket, group_by)
    parts = [from_rollup(rollup, replace(where, since=inner_since, until=inner_until), bucket, group_by)]
    if since < inner_since:
        parts.append(from_logs(logs, replace(where, until=inner_since), bucket, group_by))
    if inner_until < until:
        parts.append(from_logs(logs, replace(where, since=inner_until), bucket, group_by))
    if len(parts) == 1:
        return parts[0]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("start", "group").agg(F.sum("count").alias("count"))


def floor_minute(value: datetime) -> datetime:
    return utc(value).replace(second=0, microsecond=0)


def ceil_minute(value: datetime) -> datetime:
    floor = floor_minute(value)
    return floor if floor == utc(value) else floor + MINUTE


def as_buckets(buckets: DataFrame) -> DataFrame:
    """Buckets as they are handed out, the start as text with milliseconds."""
    return buckets.withColumn("start", iso_millis(F.col("start")))
