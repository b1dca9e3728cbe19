"""Minute, hour and day sums: what a range is made of, what it reads, and that late rows reach every level."""

from datetime import datetime, timedelta, timezone
from functools import reduce

import pytest
from conftest import utc
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import BUCKETS
from tidelog.operators import aggregate, hierarchy, rollup
from tidelog.operators.filters import LogFilter
from tidelog.sources.log_table import LogTable

START = datetime(2026, 6, 1, tzinfo=timezone.utc)
minutes = st.integers(0, 4 * 1440).map(lambda n: START + timedelta(minutes=n))


def aligned(value, step):
    return (value - START) % step == timedelta()


@settings(max_examples=300, deadline=None)
@given(minutes, minutes, st.sampled_from(sorted(BUCKETS)))
def test_spans_make_up_the_range(since, until, bucket):
    spans = list(hierarchy.cover(since, until, bucket))
    if since >= until:
        assert spans == []
        return
    assert spans[0].since == since and spans[-1].until == until
    assert all(a.until == b.since for a, b in zip(spans, spans[1:]))
    for span in spans:
        assert span.since < span.until and BUCKETS[bucket] % BUCKETS[span.grain] == timedelta()
        assert aligned(span.since, BUCKETS[span.grain]) and aligned(span.until, BUCKETS[span.grain])
    assert len(spans) <= 5
    whole = {"1d": 1440, "1h": 60, "1m": 1, "5m": 1}[bucket]
    finer = sum((s.until - s.since) // timedelta(minutes=1) for s in spans if BUCKETS[s.grain] < timedelta(minutes=whole))
    assert finer < 2 * whole  # all but the edges comes from the coarsest grain


def test_open_ranges():
    day, hour = START + timedelta(days=1), START + timedelta(days=1, hours=2)
    assert list(hierarchy.cover(None, None, "1d")) == [hierarchy.Span("1d", None, None)]
    assert list(hierarchy.cover(None, hour, "1d")) == [hierarchy.Span("1d", None, day), hierarchy.Span("1h", day, hour)]
    later = hour + timedelta(minutes=5)
    assert [s.grain for s in hierarchy.cover(later, None, "1d")] == ["1m", "1h", "1d"]
    assert [s.grain for s in hierarchy.cover(later, None, "5m")] == ["1m"]


def logs(spark, count, step_seconds):
    """Rows over services and levels, one every so many seconds and 123 microseconds."""
    at = F.timestamp_micros(F.lit(int(START.timestamp() * 1_000_000)) + F.col("id") * (step_seconds * 1_000_000 + 123))
    return spark.range(count).select(
        at.alias("timestamp"),
        F.element_at(F.array(F.lit("info"), F.lit("error")), (F.col("id") % 2 + 1).cast("int")).alias("level"),
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("service"),
        F.concat(F.lit("m"), F.col("id").cast("string")).alias("message"),
        F.try_parse_json(F.lit("{}")).alias("attributes"),
    )


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    table = LogTable(spark, str(tmp_path_factory.mktemp("levels") / "logs"))
    rows = logs(spark, 4000, 97)
    for part in range(3):  # every batch brings rows of all days
        table.append(rows.filter(F.abs(F.xxhash64("message")) % 3 == part), "s", part)
    return table


def as_set(frame):
    return {(str(r["start"]), r["group"], r["count"]) for r in frame.collect()}


EDGES = ["2026-06-01 00:00:00", "2026-06-01 22:58:59.5", "2026-06-02 00:00:00", "2026-06-03 07:30:00.000001", "2026-06-03 07:30:40", "2026-06-05 12:00:00"]


@pytest.mark.parametrize("bucket,group_by", [("1m", None), ("5m", "level"), ("1h", "service"), ("1d", None), ("1d", "service")])
def test_counts_agree_with_the_rows(spark, table, bucket, group_by):
    for low, high in ((0, 5), (1, 3), (1, 5), (3, 4), (4, 4)):
        where = LogFilter(since=utc(EDGES[low]), until=utc(EDGES[high]), level="error" if low else None)
        expected = as_set(aggregate.from_logs(table.rows(), where, bucket, group_by))
        assert as_set(table.counts(where, bucket, group_by, exact=True)) == expected
    where = LogFilter(since=utc(EDGES[1]), until=utc(EDGES[3]))
    whole = LogFilter(since=utc("2026-06-01 22:58:00"), until=utc("2026-06-03 07:31:00"))
    assert as_set(table.counts(where, bucket, group_by)) == as_set(aggregate.from_logs(table.rows(), whole, bucket, group_by))
    assert as_set(table.counts(LogFilter(), bucket, group_by)) == as_set(aggregate.from_logs(table.rows(), LogFilter(), bucket, group_by))


def test_levels_follow_late_rows(table):
    """The sums of all batches at every grain are those of a full rebuild from the rows."""
    every = rollup.build(table.rows())
    for grain in hierarchy.GRAINS:
        kept = rollup.total(table.rollup_deltas(grain=grain), rollup.MEASURES)
        full = rollup.coarsen(every, grain)
        assert sorted(kept.select(*full.columns).collect()) == sorted(full.collect())
        assert kept.select(F.countDistinct("content_low", "content_high")).first()[0] > 1


def test_a_batch_reads_only_its_own_rows(spark, tmp_path, monkeypatch):
    """The levels of a batch come from its own minutes: as many rows as it brought, however much is stored."""
    table = LogTable(spark, str(tmp_path / "logs"))
    table.append(logs(spark, 3000, 600), "s", 0)
    seen = []
    levels = hierarchy.levels

    def counted(given, *keys, **options):
        seen.append(given.agg(F.sum("log_count")).first()[0])
        return levels(given, *keys, **options)

    monkeypatch.setattr(hierarchy, "levels", counted)
    table.append(logs(spark, 5, 86_400), "s", 1)
    assert seen == [5]
    assert table.rollup_deltas(grain="1d").filter(F.col("batch_id") == "s-1").count() == 5


def test_a_month_is_read_by_its_days(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    at = F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 60)
    rows = spark.range(30 * 1440).select(
        at.alias("timestamp"), F.lit("info").alias("level"), F.lit("s").alias("service"), F.lit("m").alias("message"),
        F.try_parse_json(F.lit("{}")).alias("attributes"),
    )
    table.append(rows, "s", 0)
    read = []

    def counting(grain, where):
        found = table.rollup_deltas(where, grain)
        read.append((grain, found.count()))
        return found

    month = LogFilter(since=START, until=START + timedelta(days=30))
    assert hierarchy.counts(counting, month, "1d").agg(F.sum("count")).first()[0] == 43_200
    assert read == [("1d", 30)]
    read.clear()
    edges = LogFilter(since=START + timedelta(hours=23, minutes=50), until=START + timedelta(days=29, hours=1))
    assert hierarchy.counts(counting, edges, "1d").agg(F.sum("count")).first()[0] == 28 * 1440 + 70
    assert [g for g, _ in read] == ["1m", "1d", "1h"] and dict(read)["1d"] == 28
    assert table.rollup_deltas().count() == 43_200


def test_rebuild_compaction_and_expiry_keep_the_levels(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "logs"))
    for part in range(3):
        table.append(logs(spark, 200, 3000).filter(F.abs(F.xxhash64("message")) % 3 == part), "s", part)

    def stored():
        parts = [rollup.total(table.rollup_deltas(grain=g), rollup.MEASURES).withColumn("grain", F.lit(g)) for g in hierarchy.GRAINS]
        return sorted(reduce(DataFrame.unionByName, parts).collect())

    before = stored()
    table.rebuild_rollup()
    assert stored() == before
    table.compact()
    assert stored() == before and table.audit_content().count() == 0
    table.rebuild_rollup()
    assert stored() == before
    table.expire(START + timedelta(days=33), 30)
    kept = stored()
    assert {r["time_bucket"].date() for r in kept} == {r["log_date"] for r in table.rows().select("log_date").distinct().collect()}
    assert set(kept) < set(before)
    table.vacuum()
    assert stored() == kept and table.audit_content().count() == 0
