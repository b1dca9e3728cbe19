"""Requests as text parameters, checked and typed before any job runs."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from tidelog.functions.cursors import Cursor
from tidelog.functions.times import BUCKETS
from tidelog.functions.validation import LEVELS
from tidelog.operators import aggregate, listing
from tidelog.operators.filters import CONTAINS, LogFilter

ATTR_PREFIX = "attr."

# Answers to parameters that cannot be used.
BAD_TIME = "invalid {name}: must be a valid ISO 8601 timestamp"
BAD_LEVEL = "invalid level: must be one of debug, info, warn, error"
BAD_RANGE = "until must be later than since"
BAD_LIMIT = "limit must be a positive integer"
BAD_CURSOR = "invalid or malformed cursor"
MISSING = "{name} is required"
BAD_BUCKET = "bucket must be one of: 1m, 5m, 1h, 1d"
BAD_GROUP = "group_by must be one of: service, level"

# Fixed pattern: a date, or a date-time with an optional zone.
ISO_TIME = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?",
    re.ASCII,
)


class RequestError(ValueError):
    """A parameter that cannot be used."""


def parse_time(text: str, name: str) -> datetime:
    """Instant to the microsecond. Without a zone the time is UTC; 24:00 is the next midnight."""
    problem = RequestError(BAD_TIME.format(name=name))
    found = ISO_TIME.fullmatch(text)
    if not found:
        raise problem
    year, month, day, hour, minute, second, fraction, zone = found.groups()
    clock = (int(hour or 0), int(minute or 0), int(second or 0), int((fraction or "")[:6].ljust(6, "0")))
    if clock[0] == 24 and clock[1:] != (0, 0, 0):
        raise problem
    offset = timedelta()
    if zone and zone != "Z":
        hours, minutes = int(zone[1:3]), int(zone[4:6])
        if hours > 18 or minutes > 59:
            raise problem
        offset = timedelta(hours=hours, minutes=minutes) * (-1 if zone[0] == "-" else 1)
    try:
        start = datetime(int(year), int(month), int(day), tzinfo=timezone.utc)
        if clock[0] == 24:
            return start + timedelta(days=1) - offset
        return start.replace(hour=clock[0], minute=clock[1], second=clock[2], microsecond=clock[3]) - offset
    except (ValueError, OverflowError) as error:
        raise problem from error


def _attrs(params: Mapping[str, object]) -> dict[str, str]:
    """Attribute filters; a key given more than once (a list) is left out."""
    return {
        key.removeprefix(ATTR_PREFIX): value
        for key, value in params.items()
        if key.startswith(ATTR_PREFIX) and isinstance(value, str)
    }


def _check_level(params: Mapping[str, object]) -> None:
    if params.get("level") is not None and params["level"] not in LEVELS:
        raise RequestError(BAD_LEVEL)


def _check_range(since: datetime | None, until: datetime | None) -> None:
    if since is not None and until is not None and until <= since:
        raise RequestError(BAD_RANGE)


@dataclass(frozen=True)
class ListRequest:
    """One page, newest rows first."""

    where: LogFilter = field(default_factory=LogFilter)
    limit: int = listing.DEFAULT_LIMIT

    @classmethod
    def parse(cls, params: Mapping[str, object], q_mode: str = CONTAINS) -> ListRequest:
        _check_level(params)
        since = parse_time(params["since"], "since") if params.get("since") is not None else None
        until = parse_time(params["until"], "until") if params.get("until") is not None else None
        _check_range(since, until)
        limit = listing.DEFAULT_LIMIT
        if params.get("limit") is not None:
            if not re.fullmatch(r"[0-9]+", params["limit"]):
                raise RequestError(BAD_LIMIT)
            try:
                # More digits say no more than that the limit is too large.
                limit = listing.check_limit(int(params["limit"].lstrip("0")[:10] or 0))
            except ValueError as error:
                raise RequestError(str(error)) from error
        cursor = None
        if params.get("cursor") is not None:
            cursor = Cursor.decode(params["cursor"])
            if cursor is None:
                raise RequestError(BAD_CURSOR)
        return cls(
            LogFilter(
                since=since,
                until=until,
                service=params.get("service"),
                level=params.get("level"),
                q=params.get("q"),
                q_mode=q_mode,
                attrs=_attrs(params),
                cursor=cursor,
            ),
            limit,
        )

    def run(self, logs: DataFrame) -> listing.Page:
        return listing.fetch_page(self.where.apply(logs), self.limit)


@dataclass(frozen=True)
class AggregateRequest:
    """Counts per bucket over a required time range."""

    where: LogFilter
    bucket: str
    group_by: str | None = None

    @classmethod
    def parse(cls, params: Mapping[str, object], q_mode: str = CONTAINS) -> AggregateRequest:
        bounds = {}
        for name in ("since", "until"):
            if not params.get(name):
                raise RequestError(MISSING.format(name=name))
            bounds[name] = parse_time(params[name], name)
        _check_range(bounds["since"], bounds["until"])
        if not params.get("bucket"):
            raise RequestError(MISSING.format(name="bucket"))
        if params["bucket"] not in BUCKETS:
            raise RequestError(BAD_BUCKET)
        if params.get("group_by") is not None and params["group_by"] not in aggregate.GROUPS:
            raise RequestError(BAD_GROUP)
        _check_level(params)
        return cls(
            LogFilter(
                **bounds,
                service=params.get("service"),
                level=params.get("level"),
                q=params.get("q"),
                q_mode=q_mode,
                attrs=_attrs(params),
            ),
            params["bucket"],
            params.get("group_by"),
        )

    def run(self, logs: DataFrame, rollup: DataFrame, exact: bool = False) -> DataFrame:
        return aggregate.aggregate(logs, rollup, self.where, self.bucket, self.group_by, exact)
