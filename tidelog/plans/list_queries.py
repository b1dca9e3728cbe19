"""Scans, projections, filters, listing and paging."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.cursors import Cursor, cursor_fields, cursor_token
from tidelog.functions.times import bucket_start, iso_micros
from tidelog.operators import listing
from tidelog.operators.filters import PATTERN, LogFilter
from tidelog.plans.registry import at, over_logs, over_ties, query, stored_logs
from tidelog.plans.requests import AggregateRequest, ListRequest
from tidelog.session import fresh_path
from tidelog.sources import sample_tables as tables
from tidelog.sources.log_table import LogTable

SINCE, UNTIL = at("2024-01-08 06:30:00"), at("2024-01-20 18:00:00.5")
_SINCE, _UNTIL = "TIMESTAMP '2024-01-08 06:30:00'", "TIMESTAMP '2024-01-20 18:00:00.5'"
_ALL = "SELECT id, timestamp, level, service, message, attributes FROM logs"
_NEWEST = "ORDER BY timestamp DESC, id DESC"


def _filtered(name: str, where: LogFilter, condition: str) -> None:
    @query(name, over_logs(f"{_ALL} WHERE {condition}"))
    def run(spark, sf_dir):
        return where.apply(tables.logs(spark, sf_dir))


# -- scans and projections -----------------------------------------------------


@query("scan_logs", over_logs(_ALL))
def scan_logs(spark, sf_dir):
    return tables.logs(spark, sf_dir)


@query("project_iso_micros", over_logs("SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts_iso FROM logs"))
def project_iso_micros(spark, sf_dir):
    return tables.logs(spark, sf_dir).select("id", iso_micros(F.col("timestamp")).alias("ts_iso"))


@query(
    "project_log_entry",
    over_logs(
        """SELECT CAST(id AS VARCHAR) AS id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
        level, service, message, CASE WHEN id % 7 = 0 THEN '{}' ELSE attributes END AS attributes FROM logs"""
    ),
)
def project_log_entry(spark, sf_dir):
    logs = tables.logs(spark, sf_dir)
    some_null = F.when(F.col("id") % 7 != 0, F.col("attributes"))
    return listing.as_entries(logs.withColumn("attributes", some_null))


@query("minute_bucket", over_logs("SELECT id, date_trunc('minute', timestamp) AS time_bucket FROM logs"))
def minute_bucket(spark, sf_dir):
    return tables.logs(spark, sf_dir).select("id", bucket_start(F.col("timestamp"), "1m").alias("time_bucket"))


# -- filters -------------------------------------------------------------------

_filtered("filter_since", LogFilter(since=SINCE), f"timestamp >= {_SINCE}")
_filtered("filter_until", LogFilter(until=UNTIL), f"timestamp < {_UNTIL}")
_filtered(
    "filter_time_range",
    LogFilter(since=SINCE, until=UNTIL),
    f"timestamp >= {_SINCE} AND timestamp < {_UNTIL}",
)
_filtered("filter_service", LogFilter(service="storefront"), "service = 'storefront'")
_filtered("filter_level", LogFilter(level="error"), "level = 'error'")
_filtered(
    "filter_service_level",
    LogFilter(service="storefront", level="error"),
    "service = 'storefront' AND level = 'error'",
)
_filtered("filter_message_contains", LogFilter(q="VOUCher"), "contains(lower(message), 'voucher')")
_filtered(
    "filter_message_literal_wildcard", LogFilter(q="r_quest"), "contains(lower(message), 'r_quest')"
)
_filtered(
    "filter_message_wildcard",
    LogFilter(q="Qu_ry%swered", q_mode=PATTERN),
    r"message ILIKE '%Qu_ry%swered%' ESCAPE '\'",
)
_filtered(
    "filter_all_combined",
    LogFilter(
        since=SINCE, until=UNTIL, service="identity", level="info", q="session", attrs={"k": "42"}
    ),
    f"""timestamp >= {_SINCE} AND timestamp < {_UNTIL} AND service = 'identity' AND level = 'info'
    AND contains(lower(message), 'session') AND attributes = '{{"k": 42}}'""",
)


@query(
    "search_documents",
    "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'ation')",
)
def search_documents(spark, sf_dir):
    """``q`` over long texts in several languages."""
    documents = tables.read_table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return LogFilter(q="ATion").apply(documents).select("doc_id", "n_chars")


@query(
    "search_documents_literal",
    "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'of%%% t')",
)
def search_documents_literal(spark, sf_dir):
    """Wildcards have no meaning in a literal search."""
    documents = tables.read_table(spark, sf_dir, "documents").withColumnRenamed("text", "message")
    return LogFilter(q="OF%%% t").apply(documents).select("doc_id", "n_chars")


@query(
    "search_conversations",
    r"SELECT conv_id, turn, role FROM conversations WHERE text ILIKE '%the_e%and%' ESCAPE '\'",
)
def search_conversations(spark, sf_dir):
    turns = tables.read_table(spark, sf_dir, "conversations").withColumnRenamed("text", "message")
    return LogFilter(q="The_e%and", q_mode=PATTERN).apply(turns).select("conv_id", "turn", "role")


# -- attribute filters: expected rows from the columns the attributes were built of ----


def _attr_filtered(name: str, attrs: dict[str, str], condition: str) -> None:
    @query(name, f"SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS timestamp FROM events WHERE {condition}")
    def run(spark, sf_dir):
        return LogFilter(attrs=attrs).apply(tables.logs_attr(spark, sf_dir)).select("id", "timestamp")


_attr_filtered("filter_attr_string", {"account": "42"}, "user_id = 42")
_attr_filtered("filter_attr_bool", {"canary": "true"}, "true")
_attr_filtered("filter_attr_bool_false", {"canary": "false"}, "false")
_attr_filtered("filter_attr_number", {"attempts": "3"}, "event_id % 5 = 3")
_attr_filtered("filter_attr_number_scale", {"mixed": "3.0"}, "event_id % 3 <> 1")
_attr_filtered("filter_attr_number_or_string", {"mixed": "3"}, "true")
_attr_filtered(
    "filter_attr_multi",
    {"dock": "harbour", "attempts": "002", "canary": "true"},
    "event_id % 3 = 0 AND event_id % 5 = 2",
)


def _flag_filtered(name: str, value: str, kinds: str) -> None:
    @query(name, f"SELECT event_id AS id FROM events WHERE event_id % 8 IN ({kinds})")
    def run(spark, sf_dir):
        return LogFilter(attrs={"flag": value}).apply(tables.logs_flags(spark, sf_dir)).select("id")


_flag_filtered("filter_flag_true", "true", "0, 2")
_flag_filtered("filter_flag_false", "false", "1, 3")
_flag_filtered("filter_flag_case", "False", "6")
_flag_filtered("filter_flag_number", "1", "4, 5")
_flag_filtered("filter_flag_fraction", "1.50", "7")


@query(
    "filter_attr_stored",
    over_logs("SELECT timestamp, service, message FROM logs WHERE attributes = '{\"k\": 42}'"),
)
def filter_attr_stored(spark, sf_dir):
    """The same filter on stored VARIANT attributes."""
    rows = stored_logs(spark, sf_dir).rows(LogFilter(attrs={"k": "42.0"}))
    return rows.select("timestamp", "service", "message")


@query(
    "filter_attr_lookup",
    over_logs("SELECT timestamp, service, message FROM logs WHERE attributes = '{\"k\": 42}'"),
)
def filter_attr_lookup(spark, sf_dir):
    """The same filter on a table whose later batches keep hashes of the attribute, which their scan looks up."""
    path = fresh_path(spark, "lookup", sf_dir)
    logs = tables.logs(spark, sf_dir).withColumn("attributes", F.try_parse_json("attributes"))
    early = F.col("timestamp") < F.lit(SINCE)
    LogTable(spark, path).append(logs.filter(early), "sample", 0)
    LogTable(spark, path, lookups=["k"]).append(logs.filter(~early), "sample", 1)
    return LogTable(spark, path).rows(LogFilter(attrs={"k": "42.0"})).select("timestamp", "service", "message")


# -- listing and paging --------------------------------------------------------


@query("list_newest", over_logs(f"{_ALL} {_NEWEST} LIMIT 100"))
def list_newest(spark, sf_dir):
    return listing.newest(tables.logs(spark, sf_dir))


@query("list_limit_20", over_logs(f"{_ALL} {_NEWEST} LIMIT 20"))
def list_limit_20(spark, sf_dir):
    return listing.newest(tables.logs(spark, sf_dir), 20)


@query(
    "list_newest_stored",
    over_logs(
        f"SELECT timestamp, level, service, message FROM logs WHERE service = 'storefront' AND level = 'error' {_NEWEST} LIMIT 100"
    ),
)
def list_newest_stored(spark, sf_dir):
    """Newest rows of the stored table, newest days first."""
    found = stored_logs(spark, sf_dir).newest(LogFilter(service="storefront", level="error"), 100)
    return found.select("timestamp", "level", "service", "message")


@query(
    "page_stored_second",
    over_logs(
        f"""SELECT timestamp, level, service, message FROM (
         SELECT *, row_number() OVER ({_NEWEST}) AS n FROM logs WHERE service = 'ledger') WHERE n > 150 AND n <= 300"""
    ),
)
def page_stored_second(spark, sf_dir):
    """The second page of the stored table, by the cursor of the first, with text parameters."""
    table = stored_logs(spark, sf_dir)
    first = ListRequest.parse({"service": "ledger", "limit": "150"})
    params = {"service": "ledger", "limit": "150", "cursor": table.page(first.where, first.limit).next_cursor}
    second = ListRequest.parse(params)
    return table.newest(second.where, second.limit).select("timestamp", "level", "service", "message")


@query(
    "request_list",
    over_logs(
        f"""{_ALL} WHERE timestamp >= TIMESTAMP '2024-01-05 06:07:08.9' AND timestamp < TIMESTAMP '2024-01-20 00:00:00'
        AND level = 'warn' AND service IN ('gateway') AND contains(lower(message), 'hit') {_NEWEST} LIMIT 40"""
    ),
)
def request_list(spark, sf_dir):
    """Text parameters, checked and typed, then the page."""
    request = ListRequest.parse(
        {
            "since": "2024-01-05T06:07:08.9Z",
            "until": "2024-01-20T02:00:00+02:00",
            "level": "warn",
            "service": "gateway",
            "q": "HIT",
            "limit": "40",
        }
    )
    return listing.newest(request.where.apply(tables.logs(spark, sf_dir)), request.limit)


@query(
    "request_aggregate",
    over_logs(
        """SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS start, level AS "group", count(*) AS count FROM logs
        WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-12 12:00:00'
        AND service = 'jobs' GROUP BY ALL"""
    ),
)
def request_aggregate(spark, sf_dir):
    request = AggregateRequest.parse(
        {
            "since": "2024-01-05T00:00:00Z",
            "until": "2024-01-12T12:00:00Z",
            "bucket": "5m",
            "group_by": "level",
            "service": "jobs",
        }
    )
    table = stored_logs(spark, sf_dir)
    return request.run(table.rows(request.where), table.rollup_deltas(request.where))


_PAGE_ROWS = 200


def _page_sql(offset: int) -> str:
    return over_ties(
        f"""SELECT id, timestamp, level, service, message, attributes, CAST(n - {offset} AS INT) AS page_row,
        CASE WHEN n = {offset + _PAGE_ROWS} AND total > n
         THEN replace(replace(rtrim(to_base64(encode('{{"timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ')
          || '","id":"' || CAST(id AS VARCHAR) || '"}}')), '='), '+', '-'), '/', '_') END AS next_cursor
        FROM (SELECT *, row_number() OVER ({_NEWEST}) AS n, count(*) OVER () AS total FROM logs)
        WHERE n > {offset} AND n <= {offset + _PAGE_ROWS}"""
    )


@query("page_first", _page_sql(0))
def page_first(spark, sf_dir):
    """Many rows share a timestamp, so the page ends between rows told apart by id only."""
    return listing.page(tables.logs_ties(spark, sf_dir), _PAGE_ROWS)


@query("page_second", _page_sql(_PAGE_ROWS))
def page_second(spark, sf_dir):
    logs = tables.logs_ties(spark, sf_dir)
    token = listing.next_cursor(logs, _PAGE_ROWS).first()["next_cursor"]
    rest = replace(LogFilter(), cursor=Cursor.decode(token)).apply(logs)
    return listing.page(rest, _PAGE_ROWS)


@query(
    "page_next_cursor",
    f"SELECT next_cursor FROM ({_page_sql(0)}) WHERE next_cursor IS NOT NULL",
)
def page_next_cursor(spark, sf_dir):
    return listing.next_cursor(tables.logs_ties(spark, sf_dir), _PAGE_ROWS)


@query(
    "cursor_roundtrip",
    over_logs("SELECT id, timestamp, id % 3 <> 2 AS valid, CASE WHEN id % 3 <> 2 THEN id END AS decoded_id, CASE WHEN id % 3 <> 2 THEN timestamp END AS decoded_timestamp FROM logs"),
)
def cursor_roundtrip(spark, sf_dir):
    """Tokens of all rows, a third of them damaged, decoded as a column."""
    token = cursor_token(F.col("timestamp"), F.col("id"))
    damaged = F.when(F.col("id") % 3 == 2, F.reverse(token)).otherwise(token)
    return (
        tables.logs(spark, sf_dir)
        .select("id", "timestamp", cursor_fields(damaged).alias("decoded"))
        .select(
            "id",
            "timestamp",
            F.col("decoded").isNotNull().alias("valid"),
            F.col("decoded.id").alias("decoded_id"),
            F.col("decoded.timestamp").alias("decoded_timestamp"),
        )
    )


@query(
    "page_index",
    over_ties(
        f"""SELECT page_no, count(*) AS rows, max(timestamp) AS first_timestamp,
        max(CASE WHEN n % 100 = 0 THEN id END) AS first_id, min(timestamp) AS last_timestamp,
        max(CASE WHEN n % 100 = 99 OR n = total - 1 THEN id END) AS last_id
        FROM (SELECT *, n // 100 AS page_no FROM (SELECT id, timestamp,
          row_number() OVER ({_NEWEST}) - 1 AS n, count(*) OVER () AS total FROM logs))
        GROUP BY page_no"""
    ),
)
def page_index(spark, sf_dir):
    return listing.page_index(tables.logs_ties(spark, sf_dir), 100)


_WALKED = LogFilter(service="ledger", level="warn")
_KEPT_IDS = 50_000  # ids of a walk that the driver holds


@query(
    "walk_under_ingest",
    over_logs("SELECT timestamp, message, 1 AS times FROM logs WHERE service = 'ledger' AND level = 'warn'"),
)
def walk_under_ingest(spark, sf_dir):
    """A walk to the end of the log, page by page, while more rows of the same times arrive and batches are merged:
    every row that was there when it began comes once, and no other."""
    table = LogTable(spark, fresh_path(spark, "walk", sf_dir))
    logs = tables.logs(spark, sf_dir).withColumn("attributes", F.try_parse_json("attributes"))
    for part in range(2):
        table.append(logs.filter(F.col("id") % 2 == part), f"s{part}", 0)
    late, kept = _WALKED.apply(logs), fresh_path(spark, "walked", sf_dir)
    place, pages, ids = None, 0, []
    while place is not None or not pages:
        page = table.walk(_WALKED, 200, place)
        pages += 1
        ids += [(int(e["id"]),) for e in page.logs]
        place = page.next_cursor
        if pages <= 3:
            table.append(late, "s0", pages)
        if pages == 2:
            table.compact()
        if place is None or len(ids) >= _KEPT_IDS:
            spark.createDataFrame(ids, "id bigint").coalesce(1).write.mode("append").parquet(kept)
            ids = []
    walked = spark.read.schema("id bigint").parquet(kept).groupBy("id")
    times = walked.agg(F.count(F.lit(1)).cast("int").alias("times"))
    return table.rows().join(times, "id").select("timestamp", "message", "times")


@query(
    "page_positions",
    over_ties(f"SELECT id, timestamp, row_number() OVER ({_NEWEST}) - 1 AS position FROM logs"),
)
def page_positions(spark, sf_dir):
    """Place of every row in the full newest-first order."""
    return listing.positioned(tables.logs_ties(spark, sf_dir)).select("id", "timestamp", "position")


@query("export_newest_first", over_ties(_ALL))
def export_newest_first(spark, sf_dir):
    return listing.ordered(tables.logs_ties(spark, sf_dir))
