"""Ids of streams that write at the same time."""

import json
import threading

import pytest
from conftest import NOW, SF_DIR, plan_of
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidelog.plans import ingest_queries
from tidelog.sources import id_space
from tidelog.sources.envelopes import stream_envelopes
from tidelog.sources.log_table import LogTable
from tidelog.streaming.ingest_stream import start_ingest


def rows(spark, count):
    return spark.range(count).select(
        F.timestamp_seconds(F.lit(1_784_000_000) + F.col("id")).alias("timestamp"),
        F.lit("info").alias("level"),
        F.lit("api").alias("service"),
        F.lit("m").alias("message"),
        F.try_parse_json(F.lit("{}")).alias("attributes"),
    )


def parts(table):
    return {r[0] for r in table.rows().select(F.shiftright("id", id_space.PART_BITS)).distinct().collect()}


def test_two_streams_at_the_same_time(spark, tmp_path):
    """Both are started before either has stored anything, and each stores several batches."""
    path, queries = str(tmp_path / "table"), []
    for name in ("one", "two"):
        inbox = tmp_path / f"in-{name}"
        inbox.mkdir()
        for i in range(4):
            entries = [{"timestamp": "2026-07-18T10:00:00Z", "level": "info", "service": name, "message": "m"}] * 50
            (inbox / f"{i}.json").write_text(json.dumps({"logs": entries}))
        bodies = stream_envelopes(spark, str(inbox), max_files=1)
        queries.append(start_ingest(bodies, path, str(tmp_path / f"progress-{name}"), clock=lambda: NOW))
    for query in queries:
        query.awaitTermination()
    table = LogTable(spark, path)
    assert table.rows().count() == 400 == table.rows().select("id").distinct().count()
    by_part = table.rows().groupBy(F.shiftright("id", id_space.PART_BITS).alias("part"), "service").count().collect()
    assert sorted(r["count"] for r in by_part) == [200, 200] and len({r["part"] for r in by_part}) == 2
    assert table.audit().count() == 0 and table.audit_content().count() == 0


def test_writers_that_see_the_same_table(spark, tmp_path):
    """Threads that all start from the empty table."""
    path, errors = str(tmp_path / "table"), []

    def write(name):
        try:
            for number in range(2):
                LogTable(spark, path).append(rows(spark, 100), name, number)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(f"w{i}",)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    found = LogTable(spark, path).rows()
    assert found.count() == 800 == found.select("id").distinct().count()


def test_claims_at_the_same_moment(spark, tmp_path):
    folder, got = str(tmp_path / "ids"), {}

    def claim(name):
        got[name] = id_space.next_base(spark, folder, name, 0)

    threads = [threading.Thread(target=claim, args=(f"s{i}",)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == len(set(got.values())) == 8
    assert all(base > 0 and base % (1 << id_space.PART_BITS) == 0 for base in got.values())
    assert all(id_space.next_base(spark, folder, name, 0) == base for name, base in got.items())  # not claimed again


def test_a_used_up_part_is_followed_by_another(spark, tmp_path):
    folder = str(tmp_path / "ids")
    first = id_space.next_base(spark, folder, "a", 0)
    other = id_space.next_base(spark, folder, "b", 0)
    assert id_space.next_base(spark, folder, "a", first + 5) == first + 5
    further = id_space.next_base(spark, folder, "a", first + id_space.MOST_USED + 1)
    assert len({x >> id_space.PART_BITS for x in (first, other, further)}) == 3
    assert id_space.next_base(spark, folder, "a", first + id_space.MOST_USED + 1) == further
    assert id_space.next_base(spark, folder, "a", further + 7) == further + 7


def test_a_table_without_ids_left_says_so(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(id_space, "MOST_PARTS", 2)
    folder = str(tmp_path / "ids")
    id_space.next_base(spark, folder, "a", 0)
    with pytest.raises(ValueError):
        id_space.next_base(spark, folder, "b", 0)


def test_ids_go_on_after_compaction(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "table"))
    for number in range(2):
        for stream in ("a", "b"):
            table.append(rows(spark, 10), stream, number)
    table.compact()
    table.vacuum()
    for stream in ("a", "b"):
        table.append(rows(spark, 10), stream, 2)
    table.compact()
    table.vacuum()
    table.append(rows(spark, 10), "a", 3)
    assert table.rows().count() == 70 == table.rows().select("id").distinct().count()
    assert len(parts(table)) == 2


def test_ids_are_counted_in_shares(spark, tmp_path, monkeypatch):
    """No task combines the ids of whole files, nor sees its rows twice; shares grow in number with the rows."""
    monkeypatch.setattr(ingest_queries, "_IDS_A_TASK", 100)
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(rows(spark, 950), "a", 0)
    assert ingest_queries._by_id(table).count() == 950
    assert "hashpartitioning(id" in plan_of(ingest_queries._by_id(table)) and ", 10)" in plan_of(ingest_queries._by_id(table))
    for name in ("ids_unique", "ids_unique_two_streams"):
        found = registry.queries()[name](spark, SF_DIR)
        plan = plan_of(found)
        assert "Expand" not in plan and plan.rindex("REPARTITION_BY_NUM") > plan.rindex("Aggregate")
        assert found.first()["rows"] == found.first()["ids"] > 0


def test_no_ids(spark, tmp_path):
    assert ingest_queries._by_id(LogTable(spark, str(tmp_path / "none"))).count() == 0
