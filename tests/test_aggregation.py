import pytest
from conftest import SF_DIR, utc
from pyspark.sql import functions as F

from tidelog.operators import aggregate, rollup
from tidelog.operators.filters import LogFilter
from tidelog.plans.requests import AggregateRequest
from tidelog.sources import sample_tables


@pytest.fixture(scope="module")
def logs(spark):
    return sample_tables.logs(spark, SF_DIR).cache()


@pytest.fixture(scope="module")
def deltas(logs):
    return rollup.build(logs).cache()


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("bucket", ["1m", "5m", "1h", "1d"])
@pytest.mark.parametrize("group_by", [None, "service", "level"])
def test_rollup_equals_log_on_whole_minutes(logs, deltas, bucket, group_by):
    where = LogFilter(since=utc("2024-01-03 10:11:00"), until=utc("2024-01-20 23:59:00"), service="auth")
    raw = aggregate.from_logs(logs, where, bucket, group_by)
    assert rows(raw) == rows(aggregate.from_rollup(deltas, where, bucket, group_by))


BOUNDS = [
    ("2024-01-03 10:11:12.5", "2024-01-20 23:59:58"),
    ("2024-01-03 10:11:00", "2024-01-20 23:59:58"),
    ("2024-01-03 10:11:12", "2024-01-20 23:59:00"),
    ("2024-01-03 10:11:12", "2024-01-03 10:11:50"),
    ("2024-01-03 10:11:12", "2024-01-03 10:12:00"),
    ("2024-01-03 10:11:12", "2024-01-03 10:12:10"),
    ("2024-01-03 10:11:00", "2024-01-03 10:12:00"),
    ("2024-01-01 00:09:58.778549", "2024-01-30 23:26:16.220708"),
]


@pytest.mark.parametrize("since, until", BOUNDS)
def test_exact_counts(logs, deltas, since, until):
    where = LogFilter(since=utc(since), until=utc(until))
    raw = aggregate.from_logs(logs, where, "1h", "level")
    assert rows(aggregate.aggregate(logs, deltas, where, "1h", "level", exact=True)) == rows(raw)


def test_rollup_counts_the_minutes_of_the_bounds_whole(logs, deltas):
    first = logs.orderBy("timestamp").first()["timestamp"]
    since = utc(str(first).split(".")[0]).replace(second=59, microsecond=999999)
    where = LogFilter(since=since, until=utc("2024-01-02 00:00:00"))

    def total(frame):
        return frame.agg(F.sum("count")).first()[0]

    assert total(aggregate.aggregate(logs, deltas, where, "1d")) > total(aggregate.from_logs(logs, where, "1d"))


def test_q_and_attributes_go_to_the_log(logs, deltas):
    where = LogFilter(since=utc("2024-01-01 00:00:30"), until=utc("2024-01-31 00:00:00"), q="cache")
    assert rows(aggregate.aggregate(logs, deltas, where, "1d")) == rows(aggregate.from_logs(logs, where, "1d"))
    with pytest.raises(ValueError):
        aggregate.from_rollup(deltas, LogFilter(attrs={"k": "1"}), "1d")


def test_request_end_to_end(logs, deltas):
    request = AggregateRequest.parse(
        {"since": "2024-01-05", "until": "2024-01-06", "bucket": "1h", "group_by": "service"}
    )
    found = aggregate.as_buckets(request.run(logs, deltas)).collect()
    assert found[0]["start"].startswith("2024-01-05T") and found[0]["start"].endswith(":00:00.000Z")
    assert [(r["start"], r["group"]) for r in found] == sorted((r["start"], r["group"]) for r in found)


def test_a_hot_key_is_combined_before_the_exchange(logs):
    plan = aggregate.from_logs(logs, LogFilter(), "1d", "service")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_count")


def test_merge_and_coarsen(logs, deltas):
    parts = [rollup.build(logs.filter(F.col("id") % 4 == i)) for i in range(4)]
    assert rows(rollup.merge(*parts)) == rows(deltas)
    hours = rollup.coarsen(rollup.merge(*parts), "1h")
    assert hours.agg(F.sum("log_count")).first()[0] == logs.count()


def test_audit(logs, deltas):
    assert rollup.audit(logs, deltas).count() == 0
    assert rollup.audit(logs, deltas.unionByName(deltas.limit(1))).count() == 1
    found = rollup.audit(logs.filter("level <> 'error'"), deltas.filter("level <> 'warn'")).collect()
    assert {r["level"] for r in found} == {"error", "warn"}
    assert all(r["raw_count"] == 0 or r["rollup_count"] == 0 for r in found)
