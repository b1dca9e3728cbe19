"""Registered queries against DuckDB on the same tables."""

import os

import duckdb
import pytest
from conftest import SF_DIR, plan_of

import __spark_entry__ as registry
from tidelog.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def test_operators_and_the_pipeline():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    expected = [dict(zip(columns, row)) for row in found.fetchall()]
    got = [row.asDict() for row in frame.collect()]
    key = lambda r: repr([r[c] for c in sorted(columns)])
    assert sorted(got, key=key) == sorted(expected, key=key)


@pytest.mark.parametrize("name", ["op8_source_mixture", "op11_host_rules"])
def test_native_plan(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not any(node in plan for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoop"))
