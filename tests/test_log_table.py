"""The stored table: atomic batches, replay, ids, pruning, compaction, retention."""

import json
from dataclasses import replace
from datetime import date, timedelta

import pytest
from conftest import NOW, plan_of, utc
from pyspark.sql import functions as F

from tidelog.functions import validation as V
from tidelog.functions.cursors import Cursor
from tidelog.operators import rollup
from tidelog.operators.filters import LogFilter
from tidelog.operators.listing import fetch_page
from tidelog.operators.retention import parse_retention_days
from tidelog.sources.envelopes import stream_envelopes
from tidelog.sources.log_table import ID_ROW_BITS, LogTable
from tidelog.streaming.ingest_stream import start_ingest


def body(times, level="info", service="auth"):
    return json.dumps(
        {
            "logs": [
                {"timestamp": t, "level": level, "service": service, "message": f"m{i}", "attributes": {"i": i}}
                for i, t in enumerate(times)
            ]
        }
    )


def envelopes(spark, *bodies):
    return spark.createDataFrame([(f"b{i}", b) for i, b in enumerate(bodies)], "batch_key STRING, body STRING")


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "logs"))


DAY1, DAY2 = "2026-07-18T10:00:00.000001Z", "2026-07-19T23:59:59Z"


def counts(table):
    return {(str(r["time_bucket"]), r["service"], r["level"]): r["log_count"] for r in table.rollup().collect()}


def test_empty_table(table):
    assert table.commits() == []
    assert table.rows().count() == 0
    assert table.rejects().count() == 0
    assert table.rollup().count() == 0
    assert table.newest(LogFilter()).count() == 0
    assert table.compact() is None


def test_rows_and_rejects(spark, table):
    bad = '{"logs":[{"timestamp":"x"},7]}'
    commit = table.ingest(envelopes(spark, body([DAY1, DAY2]), bad, "{", '{"logs":[]}'), "s", 0, NOW)
    assert (commit.accepted, commit.rejected) == (2, 3)
    assert (commit.first_date, commit.last_date) == (date(2026, 7, 18), date(2026, 7, 19))
    rows = table.rows().withColumn("attributes", F.to_json("attributes")).orderBy("timestamp").collect()
    assert [(r["message"], r["attributes"], r["log_date"]) for r in rows] == [
        ("m0", '{"i":0}', date(2026, 7, 18)),
        ("m1", '{"i":1}', date(2026, 7, 19)),
    ]
    rejects = {(r["batch_key"], r["index"], r["reason"], r["entry"]) for r in table.rejects().collect()}
    assert rejects == {
        ("b1", 0, V.BAD_TIMESTAMP, '{"timestamp":"x"}'),
        ("b1", 1, V.BAD_TIMESTAMP, "7"),
        ("b2", None, V.BODY_NOT_JSON, None),
    }


def test_only_rejects(spark, table):
    commit = table.ingest(envelopes(spark, '{"logs":[1]}'), "s", 0, NOW)
    assert (commit.accepted, commit.rejected, commit.first_date) == (0, 1, None)
    assert table.rows().count() == 0 and table.rollup().count() == 0


def test_replay_changes_nothing(spark, table):
    first = table.ingest(envelopes(spark, body([DAY1])), "s", 0, NOW)
    before = [tuple(r) for r in table.rows().select("id", "timestamp").collect()]
    assert table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", 0, NOW) == first
    assert [tuple(r) for r in table.rows().select("id", "timestamp").collect()] == before
    assert sum(counts(table).values()) == 1


def test_only_committed_numbers_are_replays(spark, table):
    """A lower number that was never stored is an error, not a success without rows; also after compaction."""
    for number in (1, 2, 5):
        table.ingest(envelopes(spark, body([DAY1])), "s", number, NOW)
    for prepared in (lambda: None, table.compact, table.vacuum):
        prepared()
        for number in (1, 2, 5):
            assert table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", number, NOW).accepted in (1, 3)
        for number in (0, 3, 4):
            with pytest.raises(ValueError):
                table.ingest(envelopes(spark, body([DAY1])), "s", number, NOW)
        assert table.rows().count() == 3
    assert table.commits()[0].merged["s"] == [[1, 2], [5, 5]]
    table.ingest(envelopes(spark, body([DAY1])), "s", 9, NOW)
    table.compact()
    assert table.commits()[0].merged["s"] == [[1, 2], [5, 5], [9, 9]] and table.rows().count() == 4
    old = replace(table.commits()[0], merged={}, revision=1)  # a record of an older version
    assert old.numbers("s") == [[0, 9]]


def test_interrupted_batch_stays_invisible_and_is_overwritten(spark, table, monkeypatch):
    table.ingest(envelopes(spark, body([DAY1])), "s", 0, NOW)

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(LogTable, "_write_record", lost)
        with pytest.raises(RuntimeError):
            table.ingest(envelopes(spark, body([DAY1, DAY2, DAY2])), "s", 1, NOW)
    # rows and delta are on disk, but neither is seen
    assert table.rows().count() == 1 and sum(counts(table).values()) == 1
    # the replay yields fewer days: nothing of the first attempt is left
    table.ingest(envelopes(spark, body([DAY1])), "s", 1, NOW)
    assert table.rows().count() == 2 and sum(counts(table).values()) == 2


def test_ids_are_unique_and_follow_the_order_of_an_envelope(spark, table):
    for batch in range(3):
        table.ingest(envelopes(spark, *[body([DAY1] * 20)] * 7).repartition(3), "s", batch, NOW)
    rows = table.rows().select("id", "message").collect()
    assert len({r["id"] for r in rows}) == len(rows) == 420
    assert all(c.id_limit % (1 << ID_ROW_BITS) == 0 for c in table.commits())
    limits = [c.id_limit for c in table.commits()]
    assert limits == sorted(set(limits))
    page = fetch_page(table.rows().filter(F.col("id") >= limits[1]), 20).logs
    assert [e["message"] for e in page] == [f"m{i}" for i in range(19, -1, -1)]


def test_rollup_follows_the_rows(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY1, DAY2])), "s", 0, NOW)
    table.ingest(envelopes(spark, body([DAY1]), body([DAY1], "error")), "s", 1, NOW)
    assert counts(table) == {
        ("2026-07-18 10:00:00", "auth", "info"): 3,
        ("2026-07-18 10:00:00", "auth", "error"): 1,
        ("2026-07-19 23:59:00", "auth", "info"): 1,
    }
    assert rollup.audit(table.rows(), table.rollup()).count() == 0


def test_rebuild_repairs_a_lost_rollup(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", 0, NOW)
    whole = counts(table)
    nothing = table.rollup_deltas().limit(0).select("time_bucket", "service", "level", *rollup.MEASURES)
    broken = table.commits()[0]
    table._write_delta(broken, nothing)
    assert counts(table) == {}
    table.rebuild_rollup()
    assert counts(table) == whole
    assert [c.version for c in table.commits()] == [1]


def test_partitions_are_pruned(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", 0, NOW)
    table.ingest(envelopes(spark, body(["2026-07-01T00:00:00Z"])), "s", 1, NOW)
    where = LogFilter(since=utc("2026-07-19 00:00:00"), until=utc("2026-07-20 00:00:00"))
    found = table.rows(where)
    assert found.count() == 1
    plan = plan_of(found)
    assert "PartitionFilters: [isnotnull(log_date" in plan and "GreaterThanOrEqual(timestamp" in plan
    # the batch without a matching day is not opened at all
    assert all("batch_id=s-1/" not in f for f in found.inputFiles())
    assert plan_of(table.rollup_deltas(where)).count("FileScan") == 1


def test_newest_starts_with_the_newest_days(spark, table):
    days = [f"2026-07-{d:02d}T12:00:00Z" for d in range(1, 20)]
    table.ingest(envelopes(spark, body([d for d in days for _ in range(3)])), "s", 0, NOW)
    for limit in (1, 3, 4, 50, 57, 100):
        recent = [str(r["timestamp"]) for r in table.newest(LogFilter(), limit).collect()]
        want = sorted((d[:10] + " 12:00:00" for d in days for _ in range(3)), reverse=True)[:limit]
        assert recent == want
    assert "log_date" in plan_of(table.newest(LogFilter(), 3)).split("PartitionFilters")[1][:200]
    old = LogFilter(until=utc("2026-07-02 00:00:00"))
    assert {str(r["log_date"]) for r in table.newest(old, 3).collect()} == {"2026-07-01"}


def test_compaction(spark, table):
    for batch in range(3):
        table.ingest(envelopes(spark, body([DAY1, DAY2]), '{"logs":[0]}'), "s", batch, NOW)
    rows = sorted(r["id"] for r in table.rows().collect())
    whole = counts(table)
    merged = table.compact()
    assert (merged.batch, merged.replaces) == ("merged-0", ("s-0", "s-1", "s-2"))
    assert (merged.accepted, merged.rejected) == (6, 3)
    assert [c.batch for c in table.commits()] == ["merged-0"]
    assert sorted(r["id"] for r in table.rows().collect()) == rows
    assert counts(table) == whole and table.rejects().count() == 3
    # rejects still tell the batch they came with
    assert {(r["batch"], r["batch_key"], r["index"]) for r in table.rejects().collect()} == {
        (f"s-{n}", "b1", 0) for n in range(3)
    }
    assert table.vacuum() == ["s-0", "s-1", "s-2"]
    # a batch that was merged does not come in again; new ids do not repeat old ones
    assert table.ingest(envelopes(spark, body([DAY1])), "s", 2, NOW).batch == "merged-0"
    table.ingest(envelopes(spark, body([DAY1])), "s", 3, NOW)
    ids = [r["id"] for r in table.rows().collect()]
    assert len(set(ids)) == len(ids) == 7
    again = table.compact()
    assert (again.batch, again.replaces) == ("merged-1", ("merged-0", "s-3"))
    assert table.rows().count() == 7 and sum(counts(table).values()) == 7
    # large batches are left alone
    assert table.compact(below=1) is None


def test_retention(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", 0, NOW)
    assert table.expire(utc("2026-08-17 23:59:59")) == []
    assert table.expire(utc("2026-08-18 00:00:00")) == [date(2026, 7, 18)]
    assert [str(r["log_date"]) for r in table.rows().collect()] == ["2026-07-19"]
    assert sum(counts(table).values()) == 1
    assert table.expire(NOW + timedelta(days=400), days=1, keep_rollups=True) == [date(2026, 7, 19)]
    assert table.rows().count() == 0
    # kept rollups still answer for days whose rows are gone, also after compaction
    table.ingest(envelopes(spark, body([DAY1])), "s", 1, NOW)
    table.compact()
    assert sum(counts(table).values()) == 2


@pytest.mark.parametrize(
    "raw, days", [(None, 30), ("", 30), ("x", 30), ("0", 30), ("-5", 30), ("7", 7), ("7 days", 7), (" 9", 9)]
)
def test_retention_days(raw, days):
    assert parse_retention_days(raw) == days


@pytest.mark.parametrize("stream, number", [("s", -1), ("", 0), (None, 0), ("a/b", 0), ("merged", 0)])
def test_a_batch_needs_a_stream_and_a_number(spark, table, stream, number):
    with pytest.raises(ValueError):
        table.ingest(envelopes(spark, body([DAY1])), stream, number, NOW)


def test_pages_of_the_stored_log(spark, table):
    days = [f"2026-07-{d:02d}T12:00:00Z" for d in range(1, 20)]
    table.ingest(envelopes(spark, body([d for d in days for _ in range(5)])), "s", 0, NOW)
    seen, cursor = [], None
    while True:
        page = table.page(LogFilter(service="auth", cursor=cursor), 20)
        seen += [(e["timestamp"], int(e["id"])) for e in page.logs]
        if page.next_cursor is None:
            break
        cursor = Cursor.decode(page.next_cursor)
    assert len(seen) == 95 and seen == sorted(set(seen), reverse=True)
    assert table.page(LogFilter(service="none"), 5).logs == []
    assert table.page(LogFilter(since=utc("2026-07-19 12:00:00")), 5).next_cursor is None


def test_counts_of_the_stored_log(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY1, DAY2])), "s", 0, NOW)
    where = LogFilter(since=utc("2026-07-18 10:00:00.000002"), until=utc("2026-07-20 00:00:00"))
    whole = {str(r["start"]): r["count"] for r in table.counts(where, "1d").collect()}
    assert whole == {"2026-07-18 00:00:00": 2, "2026-07-19 00:00:00": 1}
    assert "/rows/" not in " ".join(table.counts(where, "1d").inputFiles())
    by_text = table.counts(replace(where, q="M2"), "1d", "level")
    assert [tuple(r)[1:] for r in by_text.collect()] == [("info", 1)]
    assert "/rollup/" not in " ".join(by_text.inputFiles())
    exact = {str(r["start"]): r["count"] for r in table.counts(where, "1d", exact=True).collect()}
    assert exact == {"2026-07-19 00:00:00": 1}


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "hot"), file_bytes="64KB")
    rows = spark.range(0, 40_000, 1, 4).select(
        F.timestamp_seconds(F.lit(1_784_332_800) + F.col("id") % 3600).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("api").alias("service"),
        F.sha2(F.col("id").cast("string"), 256).alias("message"),
        F.parse_json(F.lit("{}")).alias("attributes"),
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    commit = table.append(rows, "s", 0)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    assert commit.accepted == 40_000 and commit.first_date == commit.last_date
    assert len(table.rows().inputFiles()) > 1
    assert table.rows().select("id").distinct().count() == 40_000


def test_rows_of_one_scan_task_are_written_by_several(spark, tmp_path):
    """Refused envelopes are all of one day: a task with many of them must not hand them to a single other one."""
    table = LogTable(spark, str(tmp_path / "refused"), file_bytes="1MB")
    sent = spark.range(0, 600_000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("batch_key"), F.lit("").alias("body"))
    assert table.ingest(sent, "s", 0, NOW).rejected == 600_000
    assert len(table.rejects().inputFiles()) > 1
    assert table.rejects().select("batch_key").distinct().count() == 600_000


def test_a_writing_task_sorts_a_bounded_share(spark, tmp_path):
    """Rows take some fourteen times their shuffled bytes in a sort; tables and streams write alike."""
    bytes_a_task = []

    def writing(self, *args):
        bytes_a_task.append(int(self._writing()["spark.sql.adaptive.advisoryPartitionSizeInBytes"].removesuffix("MB")))
        return ingest(self, *args)

    ingest, LogTable.ingest = LogTable.ingest, writing
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.json").write_text(body([DAY1]))
        start_ingest(stream_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c"), clock=lambda: NOW).awaitTermination()
        LogTable(spark, str(tmp_path / "t")).ingest(envelopes(spark, body([DAY2])), "s", 0, NOW)
    finally:
        LogTable.ingest = ingest
    assert len(bytes_a_task) == 2 and max(bytes_a_task) <= 64


def test_streams_add_up(spark, table):
    logs = spark.range(3).select(
        F.lit("2026-07-18 10:00:00").cast("timestamp").alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("auth").alias("service"),
        F.lit("m").alias("message"),
        F.parse_json(F.lit("{}")).alias("attributes"),
    )
    table.append(logs, "load", 0)
    table.ingest(envelopes(spark, body([DAY1])), "one", 0, NOW)
    table.ingest(envelopes(spark, body([DAY1, DAY2])), "two", 0, NOW)
    assert table.rows().count() == 6 and sum(counts(table).values()) == 6
    table.compact()
    table.vacuum()
    for stream in ("load", "one", "two"):
        assert table.ingest(envelopes(spark, body([DAY1])), stream, 0, NOW).batch == "merged-0"
    table.ingest(envelopes(spark, body([DAY1])), "one", 1, NOW)
    assert table.rows().count() == 7 and table.rows().select("id").distinct().count() == 7


def test_first_years_do_not_stop_a_batch(spark, table):
    times = [
        "0000-06-01T00:00:00Z",
        "0001-01-01T00:00:00+05:00",
        "0001-01-01T00:00:00Z",
        "0001-01-02T03:00:00Z",
        DAY1,
    ]
    commit = table.ingest(envelopes(spark, body(times)), "s", 0, NOW)
    assert (commit.accepted, commit.rejected) == (3, 2)
    assert {(r["index"], r["reason"]) for r in table.rejects().collect()} == {(0, V.BAD_DATE), (1, V.BAD_DATE)}
    assert [e["timestamp"][:10] for e in table.page(LogFilter(), 5).logs] == ["2026-07-18", "0001-01-02", "0001-01-01"]
    assert table.newest(LogFilter(), 2).count() == 2 and table.newest(LogFilter(service="none")).count() == 0
    assert table.audit().count() == 0
    assert table.expire(NOW) == [date(1, 1, 1), date(1, 1, 2)]
    assert table.rows().count() == 1


def rows_read(frame):
    """Rows that the scan has handed on, by Spark's own metric."""
    execution = frame._jdf.queryExecution()
    frame._jdf.collectToPython()
    plan = execution.executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_time_bounds_skip_row_groups(spark, table):
    """Time range, cursor and rollup range read a part of one large file."""
    count = 200_000
    logs = spark.range(0, count, 1, 1).select(
        F.timestamp_micros(F.lit(1_784_332_800_000_000) + F.col("id") * 400_000).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("api").alias("service"),
        F.lit("m").alias("message"),
        F.parse_json(F.lit("{}")).alias("attributes"),
    )
    small = {"parquet.block.size": str(64 << 10), "parquet.page.row.count.limit": "2000"}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, value in small.items():
        conf.set(name, value)
    try:
        table.append(logs, "s", 0)
    finally:
        for name in small:
            conf.unset(name)
    start = utc("2026-07-18 00:00:00")
    ranged = table.rows(LogFilter(since=start + timedelta(hours=20), until=start + timedelta(hours=21)))
    assert ranged.count() == 9000 and rows_read(ranged.select("id", "timestamp")) < count / 4
    first = table.rows(LogFilter(cursor=Cursor(start + timedelta(minutes=30), 2**63 - 1)))
    assert first.count() == 4501 and rows_read(first.select("id", "timestamp")) < count / 4
    minutes = table.rollup_deltas().filter(F.col("time_bucket") < F.lit(start + timedelta(minutes=30)))
    assert minutes.count() == 30


def test_ids_go_on_beyond_the_range_of_a_task(spark, table, monkeypatch):
    from tidelog.sources import log_table

    monkeypatch.setattr(log_table, "ID_ROW_BITS", 3)
    for number in range(2):
        table.ingest(envelopes(spark, *[body([DAY1] * 20)] * 4).repartition(2), "s", number, NOW)
    stored = table._entries(table.snapshot(), "accepted").select("origin", "batch_key", "id", "message").collect()
    assert len({r["id"] for r in stored}) == 160
    envelopes_seen = {}
    for r in sorted(stored, key=lambda r: r["id"]):  # the entries of an envelope keep their order
        envelopes_seen.setdefault((r["origin"], r["batch_key"]), []).append(int(r["message"][1:]))
    assert list(envelopes_seen.values()) == [list(range(20))] * 8


def test_jobs_of_a_micro_batch(spark, table):
    table.ingest(envelopes(spark, body([DAY1])), "s", 0, NOW)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted-batch", "one batch")
    try:
        table.ingest(envelopes(spark, body([DAY1, DAY2]), "{"), "s", 1, NOW)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(tracker.getJobIdsForGroup("counted-batch")) <= 4


def test_rebuild_keeps_what_retention_kept(spark, table):
    table.ingest(envelopes(spark, body([DAY1, DAY1, DAY2])), "s", 0, NOW)
    table.ingest(envelopes(spark, body([DAY1, "2026-07-20T01:00:00Z"])), "s", 1, NOW)
    whole = counts(table)
    table.expire(utc("2026-08-18 00:00:00"), keep_rollups=True)
    assert table.rows().count() == 2 and counts(table) == whole
    table.rebuild_rollup()
    assert counts(table) == whole and table.audit().count() == 0
    assert [c.version for c in table.commits()] == [1, 1]
    table.vacuum()
    assert counts(table) == whole
    for c in table.commits():
        from tidelog.sources import paths

        assert paths.names(spark, f"{table.path}/rollup/batch_id={c.batch}") == ["version=1"]


def test_rejects_expire(spark, table):
    table.ingest(envelopes(spark, body([DAY1]), "{", '{"logs":[]}'), "s", 0, NOW)
    assert table.rejects().count() == 1 and table.envelopes().count() == 3
    table.expire(NOW + timedelta(days=31))
    assert table.rejects().count() == 0 and table.envelopes().count() == 0


def test_interrupted_expiry_shows_rows_and_rollup_alike(spark, table, monkeypatch):
    from tidelog.sources import paths

    table.ingest(envelopes(spark, body([DAY1, DAY2])), "s", 0, NOW)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(paths, "remove", lost)
        with pytest.raises(RuntimeError):
            table.expire(utc("2026-08-18 00:00:00"))
    assert table.rows().count() == 1 and sum(counts(table).values()) == 1
    table.vacuum()
    assert paths.names(spark, f"{table.path}/rows/batch_id=s-0/outcome=accepted")[-1].endswith("2026-07-19")
    assert table.rows().count() == 1


def test_status_of_stored_envelopes(spark, table):
    bodies = [body([DAY1, DAY2]), '{"logs":[1]}', "{", '{"logs":[]}', '{"logs":[7,' + body([DAY1])[10:]]
    table.ingest(envelopes(spark, *bodies), "s", 0, NOW)
    expected = {
        ("b0", "ok", None, 2),
        ("b1", "rejected", None, 0),
        ("b2", "refused", V.BODY_NOT_JSON, 0),
        ("b3", "rejected", None, 0),
        ("b4", "ok", None, 1),
    }
    for _ in range(2):
        found = table.envelopes().collect()
        assert {(r["batch_key"], r["status"], r["error"], r["accepted"]) for r in found if r["batch"] == "s-0"} == expected
        table.ingest(envelopes(spark, body([DAY1])), "other", 0, NOW)
        table.compact()
