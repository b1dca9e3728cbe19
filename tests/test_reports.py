import math

from pyspark.sql import functions as F

from tidelog.operators import reports


def nearest_rank(values, p):
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, max(0, math.ceil(p / 100 * len(ordered)) - 1))]


def test_percentiles_of_all_small_sizes(spark):
    """Sizes 1 to 60, each its own kind, with ties."""
    samples = spark.sql(
        "SELECT concat('n', n) AS kind, CAST((i * 37) % 23 AS DOUBLE) AS ms FROM "
        "(SELECT n, explode(sequence(1, n)) AS i FROM (SELECT explode(sequence(1, 60)) AS n))"
    )
    groups = {}
    for row in samples.collect():
        groups.setdefault(row["kind"], []).append(row["ms"])
    found = reports.latency_summary(samples).collect()
    assert len(found) == 60
    for row in found:
        values = groups[row["kind"]]
        assert (row["n"], row["max"]) == (len(values), max(values))
        assert [row["p50"], row["p95"], row["p99"]] == [nearest_rank(values, p) for p in (50, 95, 99)]


def test_one_kind_and_one_value_hold_most_rows(spark):
    samples = spark.range(30_000).select(
        F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("kind"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") % 1000).cast("double")).alias("ms"),
    )
    rows = {r["kind"]: r for r in reports.latency_summary(samples).collect()}
    for kind in ("hot", "rare"):
        values = [r["ms"] for r in samples.filter(F.col("kind") == kind).collect()]
        assert [rows[kind][f"p{p}"] for p in (50, 95, 99)] == [nearest_rank(values, p) for p in (50, 95, 99)]


def test_sketch_is_close(spark):
    samples = spark.range(10_000).select(F.lit("a").alias("kind"), F.col("id").cast("double").alias("ms"))
    row = reports.latency_sketch(samples).first()
    assert (row["n"], row["max"]) == (10_000, 9999.0)
    assert abs(row["p95"] - 9499) <= 2


RUN = {
    "accepted": 1_000_000, "elapsed_s": 63.8, "failed_batches": 0, "crashes": 0, "aggregate_ok": 78,
    "aggregate_p95_ms": 161.9, "query_ok": 31, "query_failed": 0, "visible_ms": 3200.0,
}


def checks(spark, **changes):
    values = {**RUN, **changes}
    schema = (
        "accepted LONG, elapsed_s DOUBLE, failed_batches LONG, crashes LONG, aggregate_ok LONG, "
        "aggregate_p95_ms DOUBLE, query_ok LONG, query_failed LONG, visible_ms DOUBLE"
    )
    run = spark.createDataFrame([tuple(values.values())], schema)
    found = reports.slo_checks(run, reports.Targets(), F.lit(1_000_000)).collect()
    return {r["name"] for r in found if not r["passed"]}


def test_slo_checks(spark):
    assert checks(spark) == set()
    assert checks(spark, elapsed_s=66.7) == {"rate"}
    assert checks(spark, crashes=1) == {"no_failures"}
    assert checks(spark, aggregate_p95_ms=1000.0) == {"aggregate_p95"}
    assert checks(spark, aggregate_p95_ms=None) == {"aggregate_p95"}
    assert checks(spark, query_ok=0) == {"queries_ok"}
    assert checks(spark, accepted=999_999) == {"accepted_rows"}
    assert checks(spark, visible_ms=20_000.0) == {"visible"}
    assert checks(spark, aggregate_ok=61) == set()
    assert checks(spark, aggregate_ok=60) == {"aggregate_rate"}


def test_throughput_of_a_single_instant_has_no_rate(spark):
    frame = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00' AS timestamp")
    row = reports.throughput(frame, F.lit(1)).first()
    assert (row["accepted"], row["elapsed_s"], row["rate"]) == (1, 0.0, None)


def test_accepted_vs_visible(spark):
    row = reports.accepted_vs_visible(spark.range(5), spark.range(4)).first()
    assert (row["accepted"], row["visible"], row["consistent"]) == (5, 4, False)
