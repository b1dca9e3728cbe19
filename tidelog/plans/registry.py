"""Registered queries, each next to SQL that states the expected result independently."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import scratch_path
from tidelog.sources import paths, sample_tables
from tidelog.sources.log_table import LogTable

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def over_logs(select: str) -> str:
    return f"WITH logs AS ({sample_tables.LOGS_SQL}) {select}"


def over_ties(select: str) -> str:
    return f"WITH logs AS ({sample_tables.LOGS_TIES_SQL}) {select}"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


_stored: dict[tuple[str, str], str] = {}


def stored_logs(spark: SparkSession, sf_dir: str) -> LogTable:
    """The log view written to a log table, once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored or not paths.exists(spark, _stored[key]):
        path = scratch_path(spark, "logs")
        logs = sample_tables.logs(spark, sf_dir)
        parsed = logs.withColumn("attributes", F.try_parse_json("attributes"))
        LogTable(spark, path).append(parsed, "sample", 0)
        _stored[key] = path
    return LogTable(spark, _stored[key])
