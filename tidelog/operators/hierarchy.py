"""Minute, hour and day sums of the rollup, and counts from the coarsest of them that fit a range.

The levels hold the same additive measures per (bucket, service, level). They are derived from minute sums in one pass, so a batch
computes the hours and days that it touched from its own minutes and nothing else; the levels of the table are the
sums of those of its batches, late rows included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import BUCKETS, bucket_start, utc
from tidelog.operators.aggregate import ceil_minute, floor_minute, from_logs, from_rollup
from tidelog.operators.filters import LogFilter

GRAINS = ("1m", "1h", "1d")  # each divides the next one
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def levels(minutes: DataFrame, *keys: str, measures: tuple[str, ...] = ("log_count",)) -> DataFrame:
    """The measures of all grains: ``keys``, grain, time_bucket, service, level. One exchange for all of them.

    ``minutes`` may hold a minute any number of times, so single rows with a count of 1 will do.
    """
    kept = [*keys, "service", "level"]
    timed = minutes.select(*kept, *measures, *[bucket_start(F.col("time_bucket"), g).alias(g) for g in GRAINS])
    grain = F.coalesce(*[F.when(F.grouping(g) == 0, F.lit(g)) for g in GRAINS])
    summed = timed.groupingSets([[*kept, g] for g in GRAINS], *kept, *GRAINS).agg(
        grain.alias("grain"), *[F.sum(m).alias(m) for m in measures]
    )
    start = F.coalesce(*[F.when(F.col("grain") == g, F.col(g)) for g in GRAINS])
    return summed.select(*keys, "grain", start.alias("time_bucket"), "service", "level", *measures)


@dataclass(frozen=True)
class Span:
    """Whole buckets of one grain. A missing bound is open."""

    grain: str
    since: datetime | None
    until: datetime | None


def _floor(value: datetime, step: timedelta) -> datetime:
    return value - (value - _EPOCH) % step


def _ceil(value: datetime, step: timedelta) -> datetime:
    floor = _floor(value, step)
    return floor if floor == value else floor + step


def usable(bucket: str) -> list[str]:
    """Grains whose buckets lie within those asked for, the coarsest first."""
    return [g for g in reversed(GRAINS) if BUCKETS[bucket] % BUCKETS[g] == timedelta()]


def cover(since: datetime | None, until: datetime | None, bucket: str) -> Iterator[Span]:
    """[since, until), bounds on whole minutes, as ranges that do not overlap: whole days in the middle, then hours, then minutes.

    Only grains that ``bucket`` consists of are used.
    """
    yield from _cover(since and utc(since), until and utc(until), usable(bucket))


def _cover(since: datetime | None, until: datetime | None, grains: list[str]) -> Iterator[Span]:
    if since is not None and until is not None and since >= until:
        return
    grain, finer = grains[0], grains[1:]
    step = BUCKETS[grain]
    first = since and (_ceil(since, step) if finer else since)
    last = until and (_floor(until, step) if finer else until)
    if first is not None and last is not None and first >= last:
        yield from _cover(since, until, finer)
        return
    if first != since:
        yield from _cover(since, first, finer)
    yield Span(grain, first, last)
    if last != until:
        yield from _cover(last, until, finer)


def counts(
    read: Callable[[str, LogFilter], DataFrame],
    where: LogFilter,
    bucket: str,
    group_by: str | None = None,
    rows: Callable[[LogFilter], DataFrame] | None = None,
) -> DataFrame:
    """Counts per bucket from the levels; ``read(grain, where)`` gives the sums of a grain in a range.

    The minutes of both bounds count whole. With ``rows(where)``, the stored rows in a range, the parts of a minute
    at both ends are counted from these instead.
    """
    since, until = where.since and utc(where.since), where.until and utc(where.until)
    if rows is None:
        inner = (since and floor_minute(since), until and ceil_minute(until))
        edges = []
    else:
        inner = (since and ceil_minute(since), until and floor_minute(until))
        if since and until and inner[0] >= inner[1]:
            inner, edges = None, [(since, until)]
        else:
            edges = [e for e in ((since, inner[0]), (inner[1], until)) if e[0] != e[1]]
    parts = []
    for span in cover(*inner, bucket) if inner else ():
        ranged = replace(where, since=span.since, until=span.until)
        parts.append(from_rollup(read(span.grain, ranged), ranged, bucket, group_by))
    for low, high in edges:
        ranged = replace(where, since=low, until=high)
        parts.append(from_logs(rows(ranged), ranged, bucket, group_by))
    if not parts:  # an empty range
        parts.append(from_rollup(read(GRAINS[0], where), replace(where, until=where.since), bucket, group_by))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.groupBy("start", "group").agg(F.sum("count").alias("count"))
