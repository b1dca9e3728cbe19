"""Envelopes, validation, the stored table, retention and streaming ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import validation as V
from tidelog.operators import ingest, reports, retention, sketches
from tidelog.plans.registry import at, over_logs, query, stored_logs
from tidelog.session import fresh_path
from tidelog.sources import id_space
from tidelog.sources import sample_tables as tables
from tidelog.sources.envelopes import stream_envelopes
from tidelog.sources.log_table import LogTable
from tidelog.streaming import progress
from tidelog.streaming.ingest_stream import start_ingest

NOW = at("2024-01-30 12:00:00")

# What each kind of sample entry must give, stated from its construction.
_REASON = f"""CASE
 WHEN kind <= 4 THEN '{V.BAD_TIMESTAMP}'
 WHEN kind = 5 THEN '{V.BAD_DATE}'
 WHEN date_trunc('milliseconds', ts) > TIMESTAMP '2024-01-30 12:05:00' THEN '{V.IN_FUTURE}'
 WHEN kind IN (7, 8) THEN '{V.BAD_LEVEL}'
 WHEN kind IN (9, 10) THEN '{V.BAD_SERVICE}'
 WHEN kind = 11 THEN '{V.BAD_MESSAGE}'
 WHEN kind = 12 THEN '{V.BAD_ATTRIBUTES}'
 WHEN kind IN (13, 16) THEN '{V.BAD_ATTRIBUTE_VALUE}'
END"""

_RAW = f"""WITH entries AS (
 SELECT event_id, ts, event_id // 100 AS batch_key, CAST(event_id % 100 AS INT) AS index,
  CAST(event_id % 20 AS INT) AS kind,
  CASE WHEN event_id % 20 IN (14, 15) THEN '{{}}' ELSE replace(props, ' ', '') END AS attributes
 FROM events),
judged AS (SELECT *, {_REASON} AS reason FROM entries)"""

_PROBLEM = f"""CASE
 WHEN event_id % 50 IN (3, 11, 23) THEN '{V.BODY_SHAPE}'
 WHEN event_id % 50 IN (29, 31) THEN '{V.BODY_NOT_JSON}'
 WHEN event_id % 50 = 37 THEN '{V.BODY_TOO_LARGE}'
END"""

_ENVELOPES = f"""WITH envelopes AS (
 SELECT event_id, ts, props, CAST(event_id AS VARCHAR) AS batch_key, {_PROBLEM} AS problem FROM events),
entries AS (
 SELECT e.event_id, e.ts, e.batch_key, CAST(i AS INT) AS index, CAST((e.event_id + 5 * i) % 20 AS INT) AS kind,
  CASE WHEN (e.event_id + 5 * i) % 20 IN (14, 15) THEN '{{}}' ELSE replace(e.props, ' ', '') END AS attributes
 FROM envelopes e, range(4) r(i)
 WHERE e.problem IS NULL AND e.event_id % 50 <> 17 AND e.event_id % 4 >= i),
judged AS (SELECT *, {_REASON} AS reason FROM entries),
reports AS (
 SELECT e.batch_key, any_value(e.problem) AS error, count(j.batch_key) FILTER (j.reason IS NULL) AS accepted,
  coalesce('[' || string_agg('{{"index":' || j.index || ',"reason":"' || j.reason || '"}}', ',' ORDER BY j.index)
   FILTER (j.reason IS NOT NULL) || ']', '[]') AS rejected
 FROM envelopes e LEFT JOIN judged j ON e.batch_key = j.batch_key GROUP BY e.batch_key)"""

# The stored table takes bodies up to the usual limit: the padded ones are then empty batches.
_STORED_ENVELOPES = _ENVELOPES.replace(
    f" WHEN event_id % 50 = 37 THEN '{V.BODY_TOO_LARGE}'\n", ""
).replace("event_id % 50 <> 17", "event_id % 50 NOT IN (17, 37)")

_STORED = "SELECT ts AS timestamp, 'info' AS level, 'auth' AS service, 'm' AS message, attributes FROM judged WHERE reason IS NULL"


def _opened(spark, sf_dir):
    return ingest.open_envelopes(tables.envelopes(spark, sf_dir), tables.ENVELOPE_BODY_LIMIT)


def _validated(spark, sf_dir):
    return ingest.validate_entries(tables.raw_entries(spark, sf_dir), NOW)


def _log_columns(rows):
    return rows.select("timestamp", "level", "service", "message", F.to_json("attributes").alias("attributes"))


# -- envelopes -----------------------------------------------------------------


@query(
    "ingest_envelope_explode",
    _ENVELOPES
    + """SELECT batch_key, index,
     CASE WHEN kind <= 2 THEN NULL WHEN kind = 3 THEN '1' WHEN kind = 5 THEN '2024-13-01T00:00:00Z'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || CASE WHEN kind = 4 THEN '' ELSE 'Z' END END AS timestamp,
     CASE WHEN kind <= 1 THEN NULL WHEN kind = 11 THEN '' ELSE 'm' END AS message
    FROM entries""",
)
def ingest_envelope_explode(spark, sf_dir):
    entries = ingest.explode_entries(_opened(spark, sf_dir))
    return entries.select(
        "batch_key",
        "index",
        F.try_variant_get("entry", "$.timestamp", "string").alias("timestamp"),
        F.try_variant_get("entry", "$.message", "string").alias("message"),
    )


@query(
    "ingest_envelope_status",
    _ENVELOPES + "SELECT batch_key, problem IS NULL AS readable, problem AS error FROM envelopes",
)
def ingest_envelope_status(spark, sf_dir):
    return _opened(spark, sf_dir).select(
        "batch_key", F.col("problem").isNull().alias("readable"), F.col("problem").alias("error")
    )


@query("ingest_batch_report", _ENVELOPES + "SELECT batch_key, accepted, rejected FROM reports WHERE error IS NULL")
def ingest_batch_report(spark, sf_dir):
    """Accepted count and rejections in index order, as JSON text."""
    report = ingest.envelope_report(_opened(spark, sf_dir), NOW).filter(F.col("error").isNull())
    return report.select("batch_key", "accepted", F.to_json("rejected").alias("rejected"))


@query(
    "ingest_batch_status",
    _ENVELOPES
    + """SELECT batch_key, CASE WHEN error IS NOT NULL THEN 'refused' WHEN accepted > 0 THEN 'ok'
    ELSE 'rejected' END AS status, error, accepted FROM reports""",
)
def ingest_batch_status(spark, sf_dir):
    """An empty batch is rejected like one without a valid entry."""
    return ingest.envelope_report(_opened(spark, sf_dir), NOW).select(
        "batch_key", "status", "error", "accepted"
    )


# -- validation ----------------------------------------------------------------


@query("validate_reason", _RAW + "SELECT event_id, reason FROM judged")
def validate_reason(spark, sf_dir):
    return _validated(spark, sf_dir).select("event_id", "reason")


@query(
    "validate_accepted",
    _RAW
    + """SELECT event_id, batch_key, index, ts AS timestamp, 'info' AS level, 'auth' AS service, 'm' AS message,
    attributes FROM judged WHERE reason IS NULL""",
)
def validate_accepted(spark, sf_dir):
    kept = ingest.accepted(_validated(spark, sf_dir))
    return kept.withColumn("attributes", F.to_json("attributes"))


@query("validate_rejected", _RAW + "SELECT batch_key, index, reason FROM judged WHERE reason IS NOT NULL")
def validate_rejected(spark, sf_dir):
    return ingest.rejected(_validated(spark, sf_dir), "batch_key")


@query(
    "reject_reason_counts",
    _RAW + "SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY reason",
)
def reject_reason_counts(spark, sf_dir):
    return ingest.reason_counts(_validated(spark, sf_dir))


# -- the stored table ----------------------------------------------------------


@query("ingest_accepted_rows", _STORED_ENVELOPES + _STORED)
def ingest_accepted_rows(spark, sf_dir):
    """Envelopes validated and written to a log table, read back."""
    table = LogTable(spark, fresh_path(spark, "ingest", sf_dir))
    table.ingest(tables.envelopes(spark, sf_dir), "sample", 0, NOW)
    return _log_columns(table.rows())


@query(
    "duplicates_preserved",
    _RAW
    + """SELECT ts AS timestamp, attributes, CAST(2 AS BIGINT) AS copies FROM judged WHERE reason IS NULL""",
)
def duplicates_preserved(spark, sf_dir):
    """Equal entries are kept as often as they come."""
    entries = tables.raw_entries(spark, sf_dir)
    kept = ingest.accepted(ingest.validate_entries(entries.unionByName(entries), NOW))
    return kept.groupBy("timestamp", F.to_json("attributes").alias("attributes")).agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    "partition_day_counts",
    over_logs("SELECT CAST(timestamp AS DATE) AS log_date, count(*) AS rows FROM logs GROUP BY ALL"),
)
def partition_day_counts(spark, sf_dir):
    return stored_logs(spark, sf_dir).rows().groupBy("log_date").agg(F.count(F.lit(1)).alias("rows"))


# -- retention -----------------------------------------------------------------

RETENTION_NOW, RETENTION_DAYS = at("2024-02-06 09:00:00"), 30
_LAST_EXPIRED = "DATE '2024-01-06'"


@query(
    "retention_surviving_rows",
    over_logs(f"SELECT timestamp, level, service, message FROM logs WHERE CAST(timestamp AS DATE) > {_LAST_EXPIRED}"),
)
def retention_surviving_rows(spark, sf_dir):
    """What is left, without reading the expired partitions; the day that is not over yet stays whole."""
    kept = retention.surviving(stored_logs(spark, sf_dir).rows(), RETENTION_NOW, RETENTION_DAYS)
    return kept.select("timestamp", "level", "service", "message")


@query(
    "retention_expired_days",
    over_logs(
        f"SELECT CAST(timestamp AS DATE) AS log_date, count(*) AS rows FROM logs WHERE CAST(timestamp AS DATE) <= {_LAST_EXPIRED} GROUP BY ALL"
    ),
)
def retention_expired_days(spark, sf_dir):
    return retention.expired_days(stored_logs(spark, sf_dir).rows(), RETENTION_NOW, RETENTION_DAYS)


@query(
    "retention_expire_stored",
    over_logs(
        f"""SELECT CAST(timestamp AS DATE) AS log_date, count(*) AS rows, count(*) AS counted FROM logs
        WHERE CAST(timestamp AS DATE) > {_LAST_EXPIRED} GROUP BY ALL"""
    ),
)
def retention_expire_stored(spark, sf_dir):
    """Expired days are dropped from the stored rows and their rollup alike."""
    table = LogTable(spark, fresh_path(spark, "expire", sf_dir))
    table.append(tables.logs(spark, sf_dir).withColumn("attributes", F.try_parse_json("attributes")), "sample", 0)
    table.expire(RETENTION_NOW, RETENTION_DAYS)
    rows = table.rows().groupBy("log_date").agg(F.count(F.lit(1)).alias("rows"))
    counted = table.rollup().groupBy(F.to_date("time_bucket").alias("log_date")).agg(F.sum("log_count").alias("counted"))
    return rows.join(counted, "log_date", "full")


_IDS_A_TASK = 1 << 20


def _by_id(table: LogTable) -> DataFrame:
    """``id`` and how many rows have it. Ids hardly repeat, so tasks get shares of them instead of combining those of whole files."""
    tasks = 1 + sum(c.accepted for c in table.commits()) // _IDS_A_TASK
    return table.rows().select("id").repartition(tasks, "id").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))


def _total(rows: str):
    return F.coalesce(F.sum(rows), F.lit(0)).alias(rows)


@query(
    "ids_unique",
    over_logs("SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (id >= 0) AS not_negative FROM logs"),
)
def ids_unique(spark, sf_dir):
    not_negative = F.when(F.col("id") >= 0, F.col("rows")).otherwise(0)
    ids = _by_id(stored_logs(spark, sf_dir)).withColumn("not_negative", not_negative)
    return ids.agg(_total("rows"), F.count("id").alias("ids"), _total("not_negative"))


@query(
    "ids_unique_two_streams",
    _STORED_ENVELOPES
    + "SELECT count(*) AS rows, count(DISTINCT (batch_key, index)) AS ids, true AS apart FROM judged WHERE reason IS NULL",
)
def ids_unique_two_streams(spark, sf_dir):
    """Two streams that run at the same time feed one table; each has a part of the id space of its own."""
    base = fresh_path(spark, "together", sf_dir)
    running = []
    for name, part in (("a", F.col("event_id") % 2 == 0), ("b", F.col("event_id") % 2 == 1)):
        files = _write_bodies(tables.envelopes(spark, sf_dir).filter(part), f"{base}/{name}")
        bodies = stream_envelopes(spark, f"{base}/{name}", whole_files=False, max_files=-(-files // 2))
        running.append((bodies, f"{base}/progress-{name}"))
    started = [start_ingest(b, f"{base}/table", progress, clock=lambda: NOW, stream=progress[-1]) for b, progress in running]
    for one in started:
        one.awaitTermination()
    ids = _by_id(LogTable(spark, f"{base}/table")).withColumn("part", F.shiftright("id", id_space.PART_BITS))
    parts = ids.groupBy("part").agg(_total("rows"), F.count("id").alias("ids"))
    return parts.agg(_total("rows"), _total("ids"), (F.count("part") == 2).alias("apart"))


@query(
    "stored_batch_status",
    _STORED_ENVELOPES
    + """SELECT batch_key, CASE WHEN error IS NOT NULL THEN 'refused' WHEN accepted > 0 THEN 'ok'
    ELSE 'rejected' END AS status, error, accepted FROM reports""",
)
def stored_batch_status(spark, sf_dir):
    """The answer to every envelope, read from the stored table."""
    table = LogTable(spark, fresh_path(spark, "status", sf_dir))
    sent = tables.envelopes(spark, sf_dir).withColumn("batch_key", F.col("batch_key").cast("string"))
    table.ingest(sent, "sample", 0, NOW)
    return table.envelopes().drop("batch")


@query(
    "visible_after_each_batch",
    _STORED_ENVELOPES
    + """SELECT CAST(b AS INT) AS batch, count(*) AS visible, count(*) AS counted, true AS audited
    FROM judged JOIN range(3) r(b) ON event_id % 3 <= b WHERE reason IS NULL GROUP BY b""",
)
def visible_after_each_batch(spark, sf_dir):
    """Rows and rollup as they stand after each of three batches, every one of them sent twice: both show a batch at once and once."""
    table = LogTable(spark, fresh_path(spark, "visible", sf_dir))
    states = []
    for number in range(3):
        sent = tables.envelopes(spark, sf_dir).filter(F.col("event_id") % 3 == number)
        for _ in ("sent", "sent again"):
            table.ingest(sent, "sample", number, NOW)
        rows = table.rows().select(F.lit(1).alias("visible"), F.lit(0).cast("bigint").alias("counted"))
        counts = table.rollup().select(F.lit(0).alias("visible"), F.col("log_count").alias("counted"))
        states.append(
            rows.unionByName(counts)
            .agg(F.sum("visible").alias("visible"), F.sum("counted").alias("counted"))
            .select(F.lit(number).alias("batch"), "visible", "counted", F.lit(table.audit_content().isEmpty()).alias("audited"))
        )
    return reduce(DataFrame.unionByName, states)


# -- streaming -----------------------------------------------------------------


def _write_bodies(envelopes, folder: str) -> int:
    """One body per line, in as many files as the cluster has cores."""
    files = max(3, envelopes.sparkSession.sparkContext.defaultParallelism)
    envelopes.select(F.col("body").alias("value")).repartition(files).write.mode("append").text(folder)
    return files


def _drain(spark, folder: str, table_path: str, checkpoint: str, max_files: int) -> None:
    bodies = stream_envelopes(spark, folder, whole_files=False, max_files=max_files)
    start_ingest(bodies, table_path, checkpoint, clock=lambda: NOW).awaitTermination()


@query("stream_ingest_logs", _STORED_ENVELOPES + _STORED)
def stream_ingest_logs(spark, sf_dir):
    """The same rows through several micro-batches."""
    base = fresh_path(spark, "stream", sf_dir)
    files = _write_bodies(tables.envelopes(spark, sf_dir), f"{base}/in")
    _drain(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", -(-files // 3))
    return _log_columns(LogTable(spark, f"{base}/table").rows())


@query("stream_two_sources", _STORED_ENVELOPES + _STORED)
def stream_two_sources(spark, sf_dir):
    """Two streams, each with its own progress, feed one table; their batches have the same numbers."""
    base = fresh_path(spark, "sources", sf_dir)
    envelopes = tables.envelopes(spark, sf_dir)
    for name, part in (("a", F.col("event_id") % 2 == 0), ("b", F.col("event_id") % 2 == 1)):
        files = _write_bodies(envelopes.filter(part), f"{base}/{name}")
        _drain(spark, f"{base}/{name}", f"{base}/table", f"{base}/progress-{name}", files)
    return _log_columns(LogTable(spark, f"{base}/table").rows())


@query("stream_progress_rate", _STORED_ENVELOPES + "SELECT count(*) AS rows, true AS within, true AS measured FROM judged WHERE reason IS NULL")
def stream_progress_rate(spark, sf_dir):
    """A stream whose limit follows its own measured progress: all rows come in, no batch exceeds the limit it ran under, and the
    reported rates have the form of those of a run."""
    base = fresh_path(spark, "paced", sf_dir)
    _write_bodies(tables.envelopes(spark, sf_dir), f"{base}/in")
    largest = spark.read.text(f"{base}/in").groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    paced = progress.ingest_paced(
        spark,
        lambda files: stream_envelopes(spark, f"{base}/in", whole_files=False, max_files=files),
        f"{base}/table",
        f"{base}/checkpoint",
        seconds=8.0,
        clock=lambda: NOW,
    )
    batches = progress.batch_rates(spark, paced)
    told = batches.agg(F.min(F.col("rows") <= F.col("files") * largest).alias("within"), F.min(F.col("rate") > 0).alias("measured"))
    stored = LogTable(spark, f"{base}/table").rows().agg(F.count(F.lit(1)).alias("rows"))
    return stored.select("rows", *[F.lit(x).alias(c) for c, x in told.first().asDict().items()])


@query(
    "stream_rollup_late",
    _STORED_ENVELOPES
    + """SELECT date_trunc('minute', ts) AS time_bucket, 'auth' AS service, 'info' AS level, count(*) AS log_count
    FROM judged WHERE reason IS NULL GROUP BY ALL""",
)
def stream_rollup_late(spark, sf_dir):
    """A month of rows, then more rows of the same month: late rows add to their old minutes."""
    base = fresh_path(spark, "late", sf_dir)
    envelopes = tables.envelopes(spark, sf_dir)
    is_late = F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0
    for part in (envelopes.filter(~is_late), envelopes.filter(is_late)):
        files = _write_bodies(part, f"{base}/in")
        _drain(spark, f"{base}/in", f"{base}/table", f"{base}/checkpoint", files)
    return LogTable(spark, f"{base}/table").rollup()


# -- run reports ---------------------------------------------------------------


def _samples(spark, sf_dir):
    return tables.read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("value").alias("ms"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("code"),
    )


_PERCENTILES = """SELECT event_type AS kind, count(*) AS n, quantile_disc(value, 0.5) AS p50,
 quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type"""


@query("latency_summary", _PERCENTILES)
def latency_summary(spark, sf_dir):
    return reports.latency_summary(_samples(spark, sf_dir))


@query(
    "latency_sketch",
    "SELECT event_type AS kind, count(*) AS n, p, true AS within FROM events, (VALUES (50), (95), (99)) v(p) GROUP BY event_type, p",
)
def latency_sketch(spark, sf_dir):
    """Sketches per minute and kind, merged per kind: every percentile lies within the stated rank error."""
    samples = _samples(spark, sf_dir)
    merged = sketches.merge(sketches.merge(sketches.build(samples), "1d"))
    return sketches.within_error(sketches.summary(merged), samples)


@query(
    "latency_sketch_days",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS time_bucket, event_type AS kind, count(*) AS n, max(value) AS max,
    true AS in_order FROM events GROUP BY ALL""",
)
def latency_sketch_days(spark, sf_dir):
    """Percentiles per day and kind from the sketches of the minutes."""
    days = sketches.summary(sketches.merge(sketches.build(_samples(spark, sf_dir)), "1d"))
    in_order = (F.col("p50") <= F.col("p95")) & (F.col("p95") <= F.col("p99")) & (F.col("p99") <= F.col("max"))
    return days.select("time_bucket", "kind", "n", "max", in_order.alias("in_order"))


@query(
    "status_tally",
    """SELECT event_type AS kind, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code, count(*) AS n
    FROM events GROUP BY ALL""",
)
def status_tally(spark, sf_dir):
    return reports.status_tally(_samples(spark, sf_dir))


@query(
    "throughput_summary",
    """SELECT accepted, elapsed_s, accepted / elapsed_s AS rate FROM (
     SELECT count(*) FILTER (event_type <> 'error') AS accepted,
      CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_s FROM events)""",
)
def throughput_summary(spark, sf_dir):
    accepted = F.when(F.col("code") == 200, 1).otherwise(0)
    return reports.throughput(_samples(spark, sf_dir), accepted)


def _run(spark, sf_dir):
    """Requests of the run are taken from the events: views aggregate, clicks query, errors fail."""
    samples = _samples(spark, sf_dir)
    spans = samples.groupBy("kind").agg(
        F.min(F.unix_micros("timestamp")).alias("first"), F.max(F.unix_micros("timestamp")).alias("last")
    )
    per_kind = reports.latency_summary(samples).join(spans, "kind")

    def of(kind: str, column: str):
        return F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(column))), F.lit(0))

    return per_kind.agg(
        F.sum("n").alias("accepted"),
        ((F.max("last") - F.min("first")) / F.lit(1_000_000)).alias("elapsed_s"),
        of("error", "n").alias("failed_batches"),
        F.lit(0).alias("crashes"),
        of("view", "n").alias("aggregate_ok"),
        of("view", "p95").alias("aggregate_p95_ms"),
        of("click", "n").alias("query_ok"),
        F.lit(0).alias("query_failed"),
        F.max("max").alias("visible_ms"),
    )


@query(
    "slo_checks",
    f"""WITH p AS ({_PERCENTILES}),
    run AS (SELECT sum(n) AS accepted, max(p95) FILTER (kind = 'view') AS p95, max(n) FILTER (kind = 'view') AS agg_ok,
      max(n) FILTER (kind = 'click') AS query_ok, max(n) FILTER (kind = 'error') AS failed, max(max) AS visible,
      (SELECT CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 FROM events) AS elapsed_s FROM p)
    SELECT 'rate' AS name, accepted / elapsed_s >= 0.001 AS passed, accepted / elapsed_s AS measured FROM run
    UNION ALL SELECT 'no_failures', failed = 0, CAST(failed AS DOUBLE) FROM run
    UNION ALL SELECT 'aggregate_p95', p95 < 1000, p95 FROM run
    UNION ALL SELECT 'queries_ok', query_ok > 0, CAST(0 AS DOUBLE) FROM run
    UNION ALL SELECT 'accepted_rows', true, CAST(accepted AS DOUBLE) FROM run
    UNION ALL SELECT 'visible', visible < 20000, visible FROM run
    UNION ALL SELECT 'aggregate_rate', agg_ok >= greatest(1, floor(elapsed_s) - 2), CAST(agg_ok AS DOUBLE) FROM run""",
)
def slo_checks(spark, sf_dir):
    return reports.slo_checks(_run(spark, sf_dir), reports.Targets(rate=0.001), F.col("accepted"))


@query(
    "slo_checks_failing",
    f"""WITH p AS ({_PERCENTILES}),
    run AS (SELECT sum(n) AS accepted, max(p95) FILTER (kind = 'view') AS p95, max(n) FILTER (kind = 'view') AS agg_ok,
      max(n) FILTER (kind = 'click') AS query_ok, max(n) FILTER (kind = 'error') AS failed, max(max) AS visible,
      (SELECT CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 FROM events) AS elapsed_s FROM p)
    SELECT 'rate' AS name, accepted / elapsed_s > 1e12 AS passed, accepted / elapsed_s AS measured FROM run
    UNION ALL SELECT 'no_failures', failed = 0, CAST(failed AS DOUBLE) FROM run
    UNION ALL SELECT 'aggregate_p95', p95 < 0.001, p95 FROM run
    UNION ALL SELECT 'queries_ok', query_ok > 0, CAST(0 AS DOUBLE) FROM run
    UNION ALL SELECT 'accepted_rows', false, CAST(accepted AS DOUBLE) FROM run
    UNION ALL SELECT 'visible', visible < 0.001, visible FROM run
    UNION ALL SELECT 'aggregate_rate', agg_ok >= greatest(1, floor(elapsed_s) - 2), CAST(agg_ok AS DOUBLE) FROM run""",
)
def slo_checks_failing(spark, sf_dir):
    """Targets that the run misses."""
    targets = reports.Targets(rate=1e12, aggregate_p95_ms=0.001, visible_ms=0.001)
    return reports.slo_checks(_run(spark, sf_dir), targets, F.col("accepted") + 1)


@query("accepted_vs_visible", "SELECT count(*) AS accepted, count(*) AS visible, true AS consistent FROM events")
def accepted_vs_visible(spark, sf_dir):
    """Rows sent to the table against rows read from it."""
    return reports.accepted_vs_visible(
        tables.logs(spark, sf_dir), stored_logs(spark, sf_dir).rows()
    )
