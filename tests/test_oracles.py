"""Every registered query against DuckDB on the same tables."""

import os

import duckdb
import pytest
from conftest import SF_DIR, plan_of

import __spark_entry__ as registry
from tidelog.plans.registry import ORACLES, QUERIES

PYTHON_NODES = ("EvalPython", "InPandas", "InArrow", "PythonUDTF")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    plan = plan_of(frame)
    assert not [node for node in PYTHON_NODES if node in plan]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert canonical(map(tuple, frame.collect()), frame.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["agg_1h_by_service", "agg_rollup_aligned", "agg_exact_edges", "agg_auto_q_attr"])
def test_buckets_come_in_order(spark, name):
    rows = [(r["start"], r["group"] or "") for r in QUERIES[name](spark, SF_DIR).collect()]
    assert rows == sorted(rows) and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", ["list_newest", "request_list", "export_newest_first"])
def test_lists_come_newest_first(spark, name):
    rows = [(r["timestamp"], r["id"]) for r in QUERIES[name](spark, SF_DIR).collect()]
    assert len(rows) > 1 and rows == sorted(rows, reverse=True)


@pytest.mark.parametrize("name", ["latency_summary", "slo_checks"])
def test_percentiles_exchange_the_samples_once(spark, name):
    """No exchange by position, and the samples are never the side that is broadcast."""
    frame = QUERIES[name](spark, SF_DIR)
    frame.collect()
    plan = plan_of(frame)
    assert "hashpartitioning(position" not in plan
    for part in plan.split("BroadcastExchange")[1:]:
        assert "Scan ExistingRDD" not in part.split("BroadcastExchange")[0][:400] or "Generate explode" in part
