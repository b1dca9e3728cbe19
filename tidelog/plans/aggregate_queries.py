"""Bucketed counts from the log and from the minute rollup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import aggregate, hierarchy, rollup
from tidelog.operators.filters import LogFilter
from tidelog.plans.registry import ORACLES, at, over_logs, query, stored_logs
from tidelog.session import fresh_path
from tidelog.sources import sample_tables as tables
from tidelog.sources.log_table import LogTable

# Bounds inside a minute, where the rollup and the exact count differ.
SINCE, UNTIL = at("2024-01-01 00:00:30"), at("2024-01-30 23:57:05")
_EXACT = "timestamp >= TIMESTAMP '2024-01-01 00:00:30' AND timestamp < TIMESTAMP '2024-01-30 23:57:05'"
_WHOLE = "timestamp >= TIMESTAMP '2024-01-01 00:00:00' AND timestamp < TIMESTAMP '2024-01-30 23:58:00'"
RANGE = LogFilter(since=SINCE, until=UNTIL)

_START = {
    "1m": "date_trunc('minute', timestamp)",
    "5m": "time_bucket(INTERVAL '5 minutes', timestamp)",
    "1h": "date_trunc('hour', timestamp)",
    "1d": "CAST(date_trunc('day', timestamp) AS TIMESTAMP)",
}
_ROLLUP = """SELECT date_trunc('minute', timestamp) AS time_bucket, service, level, count(*) AS log_count
FROM logs GROUP BY ALL"""


def _count_sql(bucket: str, group_by: str | None, condition: str) -> str:
    group = group_by or "CAST(NULL AS VARCHAR)"
    return over_logs(
        f"""SELECT {_START[bucket]} AS start, {group} AS "group", count(*) AS count
        FROM logs WHERE {condition} GROUP BY ALL"""
    )


def _raw(name: str, bucket: str, group_by: str | None = None, where=RANGE, condition: str = _EXACT) -> None:
    @query(name, _count_sql(bucket, group_by, condition))
    def run(spark, sf_dir):
        logs = tables.logs(spark, sf_dir)
        return aggregate.in_order(aggregate.from_logs(logs, where, bucket, group_by))


_raw("agg_1m", "1m")
_raw("agg_5m", "5m")
_raw("agg_1h", "1h")
_raw("agg_1d", "1d")
_raw("agg_1m_by_level", "1m", "level")
_raw("agg_5m_by_service", "5m", "service")
_raw("agg_1h_by_service", "1h", "service")
_raw("agg_1d_by_level", "1d", "level")
_raw(
    "agg_raw_q",
    "1h",
    "service",
    LogFilter(since=SINCE, until=UNTIL, q="Refused"),
    f"{_EXACT} AND contains(lower(message), 'refused')",
)
_raw(
    "agg_raw_attr",
    "1d",
    "level",
    LogFilter(since=SINCE, until=UNTIL, attrs={"k": "7"}),
    f"{_EXACT} AND attributes = '{{\"k\": 7}}'",
)


@query(
    "project_bucket_iso",
    over_logs(
        f"""SELECT strftime(start, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS start, "group", count
        FROM ({_count_sql('1h', 'service', _EXACT)})"""
    ),
)
def project_bucket_iso(spark, sf_dir):
    counted = aggregate.from_logs(tables.logs(spark, sf_dir), RANGE, "1h", "service")
    return aggregate.as_buckets(aggregate.in_order(counted))


# -- the rollup ----------------------------------------------------------------


@query("scan_minute_rollups", over_logs(_ROLLUP))
def scan_minute_rollups(spark, sf_dir):
    return stored_logs(spark, sf_dir).rollup()


@query("rollup_build", over_logs(_ROLLUP))
def rollup_build(spark, sf_dir):
    return rollup.build(tables.logs(spark, sf_dir))


@query("rollup_merge_batches", over_logs(_ROLLUP))
def rollup_merge_batches(spark, sf_dir):
    """Deltas of several batches with common keys, summed."""
    logs = tables.logs(spark, sf_dir)
    batches = [logs.filter(F.col("id") % 3 == part) for part in range(3)]
    return rollup.merge(*[rollup.build(b) for b in batches])


def _three_batches(spark, sf_dir, label: str) -> LogTable:
    """The log written as three batches, the last one twice."""
    table = LogTable(spark, fresh_path(spark, label, sf_dir))
    logs = tables.logs(spark, sf_dir).withColumn("attributes", F.try_parse_json("attributes"))
    for part in (0, 1, 2, 2):
        table.append(logs.filter(F.col("id") % 3 == part), "sample", part)
    return table


@query("rollup_upsert", over_logs(_ROLLUP))
def rollup_upsert(spark, sf_dir):
    """Each batch adds to existing minutes; a batch that comes again adds nothing."""
    return _three_batches(spark, sf_dir, "upsert").rollup()


@query("rollup_compacted", over_logs(_ROLLUP))
def rollup_compacted(spark, sf_dir):
    table = _three_batches(spark, sf_dir, "compacted")
    table.compact()
    return table.rollup()


@query("rollup_rebuild", over_logs(_ROLLUP))
def rollup_rebuild(spark, sf_dir):
    """Deltas derived anew from the stored rows."""
    table = _three_batches(spark, sf_dir, "rebuild")
    table.rebuild_rollup()
    return table.rollup()


@query("rollup_rebuild_expired", over_logs(_ROLLUP))
def rollup_rebuild_expired(spark, sf_dir):
    """Rows of the first days are expired, their rollup is kept, and a rebuild leaves it as it is."""
    table = _three_batches(spark, sf_dir, "rebuild-expired")
    table.expire(at("2024-02-06 09:00:00"), 30, keep_rollups=True)
    table.rebuild_rollup()
    return table.rollup()


def _coarse_sql(bucket: str) -> str:
    return over_logs(
        f"""SELECT {_START[bucket]} AS time_bucket, service, level, count(*) AS log_count
        FROM logs GROUP BY ALL"""
    )


@query("rollup_to_hour", _coarse_sql("1h"))
def rollup_to_hour(spark, sf_dir):
    return rollup.coarsen(stored_logs(spark, sf_dir).rollup_deltas(), "1h")


@query("rollup_to_day", _coarse_sql("1d"))
def rollup_to_day(spark, sf_dir):
    return rollup.coarsen(stored_logs(spark, sf_dir).rollup_deltas(), "1d")


@query(
    "agg_rollup_aligned",
    _count_sql(
        "1h",
        "service",
        "timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 12:30:00'",
    ),
)
def agg_rollup_aligned(spark, sf_dir):
    where = LogFilter(since=at("2024-01-03 00:00:00"), until=at("2024-01-25 12:30:00"))
    deltas = stored_logs(spark, sf_dir).rollup_deltas(where)
    return aggregate.in_order(aggregate.from_rollup(deltas, where, "1h", "service"))


@query("agg_rollup_unaligned", _count_sql("1h", "service", _WHOLE))
def agg_rollup_unaligned(spark, sf_dir):
    """The minutes of both bounds count whole."""
    deltas = stored_logs(spark, sf_dir).rollup_deltas(RANGE)
    return aggregate.in_order(aggregate.from_rollup(deltas, RANGE, "1h", "service"))


@query(
    "agg_auto_service_level",
    _count_sql("5m", "level", f"{_WHOLE} AND service = 'storefront' AND level = 'error'"),
)
def agg_auto_service_level(spark, sf_dir):
    """Filters on service and level stay on the rollup."""
    where = LogFilter(since=SINCE, until=UNTIL, service="storefront", level="error")
    return stored_logs(spark, sf_dir).counts(where, "5m", "level")


@query(
    "agg_auto_q_attr",
    _count_sql("1d", "service", f"{_EXACT} AND contains(lower(message), 'without') AND attributes = '{{\"k\": 9}}'"),
)
def agg_auto_q_attr(spark, sf_dir):
    """Message and attribute filters need the stored rows."""
    where = LogFilter(since=SINCE, until=UNTIL, q="without", attrs={"k": "9"})
    return stored_logs(spark, sf_dir).counts(where, "1d", "service")


@query("agg_exact_edges", _count_sql("1h", "service", _EXACT))
def agg_exact_edges(spark, sf_dir):
    """Whole minutes from the rollup, the rest of the range from the rows."""
    return stored_logs(spark, sf_dir).counts(RANGE, "1h", "service", exact=True)


@query("agg_hierarchy_edges", _count_sql("1d", "service", _EXACT))
def agg_hierarchy_edges(spark, sf_dir):
    """Whole days from the day sums, then hours, then minutes; parts of a minute from the rows."""
    return stored_logs(spark, sf_dir).counts(RANGE, "1d", "service", exact=True)


@query("agg_hierarchy_hours", _count_sql("1h", "level", f"{_WHOLE} AND service = 'ledger'"))
def agg_hierarchy_hours(spark, sf_dir):
    """Hours of a service from the hour sums, the minutes of both bounds whole."""
    where = LogFilter(since=SINCE, until=UNTIL, service="ledger")
    return stored_logs(spark, sf_dir).counts(where, "1h", "level")


@query(
    "rollup_levels",
    over_logs(
        " UNION ALL ".join(
            f"SELECT '{g}' AS grain, {_START[g]} AS time_bucket, service, level, count(*) AS log_count FROM logs GROUP BY ALL"
            for g in hierarchy.GRAINS
        )
    ),
)
def rollup_levels(spark, sf_dir):
    """Minutes, hours and days in one pass."""
    return hierarchy.levels(rollup.build(tables.logs(spark, sf_dir)))


@query("rollup_levels_late", ORACLES["rollup_levels"])
def rollup_levels_late(spark, sf_dir):
    """Every batch brings rows of the whole month again; each adds the hours and days that it touched."""
    table = _three_batches(spark, sf_dir, "levels")
    parts = [rollup.total(table.rollup_deltas(grain=g)).withColumn("grain", F.lit(g)) for g in hierarchy.GRAINS]
    return reduce(DataFrame.unionByName, parts)


@query(
    "audit_altered_messages",
    over_logs(
        """SELECT date_trunc('minute', timestamp) AS time_bucket, service, level, count(*) AS raw_count, count(*) AS rollup_count
        FROM logs GROUP BY ALL HAVING count(*) FILTER (date_part('second', timestamp) = 7) > 0"""
    ),
)
def audit_altered_messages(spark, sf_dir):
    """Some stored messages are changed afterwards; the counts agree, the sums of hashes do not."""
    table = stored_logs(spark, sf_dir)
    changed = F.when(F.second("timestamp") == 7, F.concat("message", F.lit("."))).otherwise(F.col("message"))
    return rollup.audit_content(table.rows().withColumn("message", changed), table.rollup_deltas())


@query(
    "rollup_audit",
    over_logs(
        """SELECT date_trunc('minute', timestamp) AS time_bucket, service, level, count(*) AS raw_count,
        CAST(0 AS BIGINT) AS rollup_count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-28 00:00:00' GROUP BY ALL
        UNION ALL
        SELECT date_trunc('minute', timestamp), service, level, CAST(0 AS BIGINT), count(*)
        FROM logs WHERE timestamp < TIMESTAMP '2024-01-02 00:00:00' GROUP BY ALL"""
    ),
)
def rollup_audit(spark, sf_dir):
    """A rollup that lags two days behind a log whose first day was dropped."""
    logs = tables.logs(spark, sf_dir)
    lagging = rollup.build(LogFilter(until=at("2024-01-28 00:00:00")).apply(logs))
    return rollup.audit(LogFilter(since=at("2024-01-02 00:00:00")).apply(logs), lagging)
