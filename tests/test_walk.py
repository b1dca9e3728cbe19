"""Walks over a table that goes on growing, and streams that pace themselves."""

import json

import pytest
from conftest import NOW, utc
from pyspark.sql import functions as F

from tidelog.functions.cursors import Cursor, Walk
from tidelog.operators.filters import LogFilter
from tidelog.operators.reports import throughput
from tidelog.sources.envelopes import stream_envelopes
from tidelog.sources.log_table import LogTable
from tidelog.streaming.progress import Report, batch_rates, ingest_paced, next_limit


def rows(spark, name, count, step=60):
    return spark.range(count).select(
        F.timestamp_seconds(F.lit(1_784_000_000) + F.col("id") * step).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("api").alias("service"),
        F.concat(F.lit(name), F.col("id").cast("string")).alias("message"),
        F.try_parse_json(F.lit("{}")).alias("attributes"),
    )


def walked(table, limit, meanwhile=()):
    place, out, steps = None, [], iter(meanwhile)
    while True:
        page = table.walk(LogFilter(), limit, place)
        out += [e["message"] for e in page.logs]
        place = page.next_cursor
        if place is None:
            return out
        next(steps, lambda: None)()


def test_a_walk_shows_what_was_there_when_it_began(spark, tmp_path):
    """Older and newer rows, further batches of known and new streams, and batches merged with later ones."""
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(rows(spark, "a", 30), "a", 0)
    table.append(rows(spark, "b", 30, 61), "b", 4)
    expected = [r["message"] for r in table.rows().orderBy(F.col("timestamp").desc(), F.col("id").desc()).collect()]
    late = [
        lambda: table.append(rows(spark, "late", 40, 59), "a", 1),
        lambda: table.append(rows(spark, "new", 40, 1), "c", 0),
        table.compact,
        lambda: table.append(rows(spark, "more", 5), "b", 5),
        table.compact,
    ]
    assert walked(table, 9, late) == expected
    assert len(walked(table, 100)) == 60 + 85


def test_a_walk_of_an_empty_table(spark, tmp_path):
    assert LogTable(spark, str(tmp_path / "logs")).walk(LogFilter(), 5).logs == []


def test_places_of_a_walk():
    place = Walk(Cursor(NOW, 7), {"s1": 3, "s2": 0})
    assert Walk.decode(place.encode()) == place
    assert Cursor.decode(place.encode()) == place.cursor
    assert Walk.decode(place.cursor.encode()) is None and Walk.decode("x") is None and Walk.decode("") is None
    for seen in ({"s": -1}, {"s": True}, {"s": "1"}):
        assert Walk.decode(Walk(Cursor(NOW, 7), seen).encode()) is None


def test_a_plain_cursor_is_no_place_in_a_walk(spark, tmp_path):
    with pytest.raises(ValueError):
        LogTable(spark, str(tmp_path / "logs")).walk(LogFilter(), 5, Cursor(NOW, 1).encode())


def test_limits_follow_the_time_a_batch_took():
    report = lambda seconds: Report("r", 0, "", 10, seconds)
    assert next_limit(4, report(2.0), 10.0, 100) == 20
    assert next_limit(4, report(40.0), 10.0, 100) == 1
    assert next_limit(4, report(0.0), 10.0, 100) == 100


def test_a_paced_stream_brings_everything_in(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(12):
        entries = [{"timestamp": "2026-07-18T10:00:00Z", "level": "info", "service": "api", "message": f"m{i}"}] * 3
        (inbox / f"{i:02}.json").write_text(json.dumps({"logs": entries}))
    paced = ingest_paced(
        spark,
        lambda files: stream_envelopes(spark, str(inbox), max_files=files),
        str(tmp_path / "table"),
        str(tmp_path / "progress"),
        seconds=1000.0,
        most_files=5,
        adjustments=1,
        clock=lambda: NOW,
    )
    table = LogTable(spark, str(tmp_path / "table"))
    assert table.rows().count() == 36 and table.rows().select("message").distinct().count() == 12
    assert list(paced.limits.values()) == [1, 5]
    told = batch_rates(spark, paced).collect()
    assert told and all(r["rows"] <= r["files"] and r["rate"] > 0 for r in told)
    assert len({r["batch"] for r in told}) == len(told)
    rates = throughput(batch_rates(spark, paced), F.col("rows")).first()
    assert 0 < rates["accepted"] <= 12


def test_a_walk_reads_ahead(spark, tmp_path):
    """Far fewer jobs than pages, and every page as if it were the first to be read."""
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(rows(spark, "a", 900, 300), "a", 0)
    table.append(rows(spark, "b", 300, 7), "b", 0)
    expected = [r["message"] for r in table.rows().orderBy(F.col("timestamp").desc(), F.col("id").desc()).collect()]
    spark.sparkContext.setJobGroup("ahead", "a walk")
    found = walked(table, 10)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("ahead"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == expected and jobs < 60  # 120 pages


def test_pages_read_ahead_hold_no_expired_days(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(rows(spark, "a", 60, 21_600), "a", 0)
    place, got = None, []
    for _ in range(4):  # three more pages are read with the fourth
        page = table.walk(LogFilter(), 4, place)
        got += page.logs
        place = page.next_cursor
    held = table._ahead.pages
    assert place in held and len(held) >= 2
    last = utc(got[-1]["timestamp"][:19].replace("T", " "))
    table.expire(last, 1)  # days that the next pages reach
    fresh = LogTable(spark, table.path)
    while place is not None:
        page, same = table.walk(LogFilter(), 4, place), fresh.walk(LogFilter(), 4, place)
        assert page == same
        got += page.logs
        place = page.next_cursor
    assert len(got) < 60 and len({e["id"] for e in got}) == len(got)


def test_walks_side_by_side_and_other_limits(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(rows(spark, "a", 80), "a", 0)
    expected = [r["message"] for r in table.rows().orderBy(F.col("timestamp").desc(), F.col("id").desc()).collect()]
    places, out = [None, None], [[], []]
    for _ in range(4):
        for i, limit in enumerate((5, 20)):
            page = table.walk(LogFilter(), limit, places[i])
            out[i] += [e["message"] for e in page.logs]
            places[i] = page.next_cursor
    assert out == [expected[:20], expected] and places[1] is None
    page = table.walk(LogFilter(), 60, places[0])
    assert [e["message"] for e in page.logs] == expected[20:] and page.next_cursor is None
