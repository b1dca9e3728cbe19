"""Percentiles from sketches that are merged over minutes, and the audit by content."""

import math

from conftest import plan_of
from pyspark.sql import functions as F

from tidelog.operators import rollup, sketches
from tidelog.sources import paths
from tidelog.sources.log_table import LogTable


def samples(spark, count=60_000):
    skewed = F.when(F.col("id") % 10 < 3, F.lit(7.0)).otherwise(F.exp((F.col("id") * 2654435761 % 1_000_003) / 150_000.0))
    return spark.range(0, count, 1, 6).select(
        F.concat(F.lit("k"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).cast("string")).alias("kind"),
        skewed.alias("ms"),
        F.timestamp_seconds(F.lit(1_784_000_000) + F.col("id") % 40_000).alias("timestamp"),
    )


def exact(spark, given):
    out = {}
    for r in given.collect():
        out.setdefault(r["kind"], []).append(r["ms"])
    return {k: sorted(v) for k, v in out.items()}


def test_every_percentile_lies_within_the_rank_error(spark):
    given = samples(spark).cache()
    built = sketches.build(given)
    by_kind = exact(spark, given)
    for merged in (sketches.merge(built), sketches.merge(sketches.merge(built, "1h")), sketches.merge(sketches.merge(built, "1d"))):
        for row in sketches.summary(merged).collect():
            values = by_kind[row["kind"]]
            assert row["n"] == len(values) and row["max"] == values[-1]
            slack = sketches.rank_error() * len(values) + 1
            for p in (50, 95, 99):
                low = sum(v < row[f"p{p}"] for v in values)
                high = sum(v <= row[f"p{p}"] for v in values)
                assert low <= p / 100 * len(values) + slack and high >= p / 100 * len(values) - slack
        assert all(r["within"] for r in sketches.within_error(sketches.summary(merged), given).collect())


def test_wrong_percentiles_are_told(spark):
    given = samples(spark, 3000)
    wrong = sketches.summary(sketches.merge(sketches.build(given))).withColumn("p95", F.col("p50"))
    told = {(r["kind"], r["p"]): r["within"] for r in sketches.within_error(wrong, given).collect()}
    assert told == {(k, p): p != 95 for k in ("k0", "k1") for p in (50, 95, 99)}


def test_samples_without_a_number(spark):
    rows = [("a", None), ("a", math.nan), ("a", 2.0), ("a", math.inf), (None, 1.0), ("b", None)]
    given = spark.createDataFrame(rows, "kind string, ms double").withColumn("timestamp", F.lit("2026-07-01 00:00:00").cast("timestamp"))
    found = {r["kind"]: (r["n"], r["p50"], r["max"]) for r in sketches.summary(sketches.merge(sketches.build(given))).collect()}
    assert found == {"a": (2, 2.0, math.inf), None: (1, 1.0, 1.0)}
    assert sketches.summary(sketches.merge(sketches.build(given.limit(0)))).collect() == []


def test_only_sketches_are_exchanged(spark):
    """Samples are sketched before the only exchange of a build; a merge exchanges sketches."""
    plan = plan_of(sketches.build(samples(spark)))
    assert plan.count("Exchange") == 1 and "partial_kll_sketch_agg_double" in plan.split("Exchange")[1]
    assert "repartitionByRange" not in plan and "rangepartitioning" not in plan


def logs(spark, table, batches=2):
    for number in range(batches):
        given = spark.range(200).select(
            F.timestamp_seconds(F.lit(1_784_000_000) + F.col("id") * 7).alias("timestamp"),
            F.lit("info").alias("level"),
            F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("service"),
            F.concat(F.lit("message "), F.col("id").cast("string")).alias("message"),
            F.try_parse_json(F.concat(F.lit('{"b":1,"a":'), F.col("id").cast("string"), F.lit("}"))).alias("attributes"),
        )
        table.append(given, "s", number)
    return table


def damaged(spark, table, change):
    """Write the rows of the first batch anew, changed, as a faulty job or disk would."""
    folder = paths.matching(spark, f"{table.path}/rows/batch_id=s-0/outcome=accepted/log_date=*")[0]
    rows = spark.read.parquet(folder).collect()
    kinds = spark.read.parquet(folder).schema
    spark.createDataFrame(change([r.asDict() for r in rows]), kinds).write.mode("overwrite").parquet(folder)


def found(table):
    return [(r["service"], r["raw_count"] - r["rollup_count"]) for r in table.audit_content().collect()]


def test_an_altered_message_is_found_at_equal_counts(spark, tmp_path):
    table = logs(spark, LogTable(spark, str(tmp_path / "logs")))
    assert found(table) == [] and table.audit().count() == 0

    def one_message(rows):
        rows[5]["message"] += " "
        return rows

    damaged(spark, table, one_message)
    assert table.audit().count() == 0
    assert len(found(table)) == 1 and found(table)[0][1] == 0


def test_a_lost_and_a_repeated_row_are_found(spark, tmp_path):
    table = logs(spark, LogTable(spark, str(tmp_path / "logs")))
    same = lambda rows: [r for r in rows if (r["service"], r["timestamp"].minute) == (rows[0]["service"], rows[0]["timestamp"].minute)]

    def swapped(rows):  # one row lost, another one of its minute twice
        a, b = same(rows)[:2]
        return [r for r in rows if r is not a] + [b]

    damaged(spark, table, swapped)
    assert table.audit().count() == 0 and [d for _, d in found(table)] == [0]


def test_sums_of_hashes_add_up(spark, tmp_path):
    """One batch, several batches, after compaction and after a rebuild."""
    table = logs(spark, LogTable(spark, str(tmp_path / "logs")), 3)
    sums = lambda: sorted(rollup.total(table.rollup_deltas(), rollup.MEASURES).collect())
    before = sums()
    table.compact()
    assert sums() == before
    table.rebuild_rollup()
    assert sums() == before and found(table) == []
