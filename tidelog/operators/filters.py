"""The filter layer: every condition optional, all of them joined with AND."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.attributes import attrs_match
from tidelog.functions.cursors import Cursor
from tidelog.functions.patterns import contains_ignore_case, matches_pattern
from tidelog.functions.times import ts_literal, utc

CONTAINS = "contains"
PATTERN = "pattern"


@dataclass(frozen=True)
class LogFilter:
    """``since`` is inclusive, ``until`` exclusive; an empty service or ``q`` means no condition.

    ``q`` is a literal substring, or with ``q_mode="pattern"`` a LIKE pattern
    between two ``%``. Both ignore case.
    """

    since: datetime | None = None
    until: datetime | None = None
    service: str | None = None
    level: str | None = None
    q: str | None = None
    q_mode: str = CONTAINS
    attrs: Mapping[str, str] = field(default_factory=dict)
    cursor: Cursor | None = None

    def apply(self, logs: DataFrame) -> DataFrame:
        for condition in self.conditions(logs):
            logs = logs.filter(condition)
        return logs

    def conditions(self, logs: DataFrame) -> list[Column]:
        found = time_conditions(logs, self.since, self.until)
        if self.service:
            found.append(F.col("service") == self.service)
        if self.level:
            found.append(F.col("level") == self.level)
        if self.cursor is not None:
            found += before_cursor(logs, self.cursor)
        if self.q:
            if self.q_mode not in (CONTAINS, PATTERN):
                raise ValueError(f"unknown q_mode {self.q_mode!r}")
            search = matches_pattern if self.q_mode == PATTERN else contains_ignore_case
            found.append(search(F.col("message"), self.q))
        if self.attrs:
            is_text = isinstance(logs.schema["attributes"].dataType, T.StringType)
            found.append(attrs_match(F.col("attributes"), self.attrs, is_text))
        return found


def time_conditions(
    logs: DataFrame,
    since: datetime | None,
    until: datetime | None,
    column: str = "timestamp",
    date_column: str = "log_date",
) -> list[Column]:
    """Range on the time column, and the same range on the partition column where there is one:
    Spark does not derive partition bounds from the time bounds."""
    found = []
    partitioned = date_column in logs.columns
    if since is not None:
        found.append(F.col(column) >= ts_literal(since))
        if partitioned:
            found.append(F.col(date_column) >= F.lit(utc(since).date()))
    if until is not None:
        found.append(F.col(column) < ts_literal(until))
        if partitioned:
            found.append(F.col(date_column) <= F.lit(last_day_before(until)))
    return found


def last_day_before(until: datetime) -> date:
    """The last UTC day with an instant before the exclusive bound."""
    return (utc(until) - timedelta(microseconds=1)).date()


def before_cursor(logs: DataFrame, cursor: Cursor) -> list[Column]:
    """Rows after the cursor in newest-first order.

    A comparison of structs reaches no scan; the bound on time alone does, and
    the second condition settles ties.
    """
    at = ts_literal(cursor.timestamp)
    ts = F.col("timestamp")
    found = [ts <= at, (ts < at) | ((ts == at) & (F.col("id") < cursor.id))]
    if "log_date" in logs.columns:
        found.append(F.col("log_date") <= F.lit(utc(cursor.timestamp).date()))
    return found
