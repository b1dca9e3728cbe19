"""Run reports over a table of samples: latency percentiles, tallies, rates, checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidelog.operators.positions import in_ranges

# Reported percentiles.
PERCENTILES = (50, 95, 99)

# Up to about this many kinds the wanted ranks (a few numbers each) are sent to every task.
MOST_KINDS = 100_000


def latency_summary(samples: DataFrame, kind: str = "kind", value: str = "ms") -> DataFrame:
    """Exact nearest-rank percentiles (rank ``ceil(p/100*n)``), maximum and count per kind.

    ``percentile_disc`` keeps all distinct values of a kind in one task. Here the
    samples are ordered across partitions instead and the wanted ranks picked by
    position; the salt lets a kind or value that holds much of the data spread out.
    """
    salted = samples.select(
        F.col(kind).alias("kind"),
        F.col(value).alias("value"),
        F.monotonically_increasing_id().alias("salt"),
    ).filter(F.col("value").isNotNull())
    seen = Observation()
    placed = in_ranges(salted, "kind", "value", "salt", seen=seen, kinds=F.approx_count_distinct("kind"))
    # One row per kind and partition that holds it: how many samples of the kind lie before and in it.
    runs = placed.groupBy("kind", "_part").agg(
        F.count(F.lit(1)).alias("rows"), F.min("_slot").alias("first"), F.max("value").alias("most")
    )
    of_kind = Window.partitionBy("kind")
    before = of_kind.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "kind",
        "rows",
        "first",
        F.sum("rows").over(of_kind).alias("n"),
        F.max("most").over(of_kind).alias("max"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
    )
    ranks = [F.struct(F.lit(p).alias("p"), (F.ceil(F.lit(p / 100) * F.col("n")) - 1).alias("rank")) for p in PERCENTILES]
    within = F.col("rank.rank") - F.col("before")
    wanted = (
        runs.withColumn("rank", F.explode(F.array(*ranks)))
        .filter((within >= 0) & (within < F.col("rows")))
        .select("kind", "n", "max", "rank.p", (F.col("first") + within).alias("_slot"))
    )
    # The wanted ranks go to the samples: a second exchange of all samples is left to more kinds than are ever reported.
    if seen.get["kinds"] <= MOST_KINDS:
        wanted = F.broadcast(wanted)
    picked = placed.select("_slot", "value").join(wanted, "_slot")
    return picked.groupBy("kind", "n", "max").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{p}") for p in PERCENTILES]
    ).select("kind", "n", *[f"p{p}" for p in PERCENTILES], "max")


def latency_sketch(
    samples: DataFrame, kind: str = "kind", value: str = "ms", accuracy: int = 10_000
) -> DataFrame:
    """The same summary from a mergeable sketch: one pass, rank error at most n/accuracy."""
    fractions = [p / 100 for p in PERCENTILES]
    return (
        samples.groupBy(F.col(kind).alias("kind"))
        .agg(
            F.count(value).alias("n"),
            F.percentile_approx(value, fractions, accuracy).alias("_p"),
            F.max(value).alias("max"),
        )
        .select("kind", "n", *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)], "max")
    )


def status_tally(samples: DataFrame, kind: str = "kind", code: str = "code") -> DataFrame:
    return samples.groupBy(F.col(kind).alias("kind"), F.col(code).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )


def throughput(samples: DataFrame, accepted: Column, ts: str = "timestamp") -> DataFrame:
    """Accepted rows, elapsed seconds between first and last sample, and their rate."""
    elapsed = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1_000_000)
    return samples.agg(
        F.sum(accepted).cast("bigint").alias("accepted"), elapsed.alias("elapsed_s")
    ).withColumn("rate", F.col("accepted") / F.nullif(F.col("elapsed_s"), F.lit(0.0)))


@dataclass(frozen=True)
class Targets:
    """The targets of a run."""

    rate: float = 15_000
    aggregate_p95_ms: float = 1_000
    visible_ms: float = 20_000


def slo_checks(run: DataFrame, targets: Targets, expected_rows: Column) -> DataFrame:
    """One row per check from a one-row run summary with the columns

    ``accepted, elapsed_s, failed_batches, crashes, aggregate_ok, aggregate_p95_ms,
    query_ok, query_failed, visible_ms``.
    """
    c = F.col
    elapsed_whole = F.floor(c("elapsed_s")).cast("bigint")
    checks = [
        ("rate", c("accepted") / c("elapsed_s") >= targets.rate, c("accepted") / c("elapsed_s")),
        ("no_failures", (c("failed_batches") == 0) & (c("crashes") == 0), c("failed_batches") + c("crashes")),
        ("aggregate_p95", c("aggregate_p95_ms") < targets.aggregate_p95_ms, c("aggregate_p95_ms")),
        ("queries_ok", (c("query_ok") > 0) & (c("query_failed") == 0), c("query_failed")),
        ("accepted_rows", c("accepted") >= expected_rows, c("accepted")),
        ("visible", c("visible_ms") < targets.visible_ms, c("visible_ms")),
        (
            "aggregate_rate",
            c("aggregate_ok") >= F.greatest(F.lit(1).cast("bigint"), elapsed_whole - 2),
            c("aggregate_ok"),
        ),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.coalesce(passed, F.lit(False)).alias("passed"),
                measured.cast("double").alias("measured"),
            )
            for name, passed, measured in checks
        ]
    )
    return run.select(F.inline(rows))


def accepted_vs_visible(accepted: DataFrame, visible: DataFrame) -> DataFrame:
    """Row counts of both sides and whether they agree; two one-row aggregates."""
    sides = accepted.agg(F.count(F.lit(1)).alias("accepted"), F.lit(0).cast("bigint").alias("visible")).unionByName(
        visible.agg(F.lit(0).cast("bigint").alias("accepted"), F.count(F.lit(1)).alias("visible"))
    )
    return sides.agg(
        F.sum("accepted").alias("accepted"), F.sum("visible").alias("visible")
    ).withColumn("consistent", F.col("accepted") == F.col("visible"))
