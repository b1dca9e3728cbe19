"""Percentiles over time from mergeable sketches: kept per minute and kind, merged for any longer bucket on read.

A KLL sketch of ``k`` holds a few k values whatever the number of samples, so a bucket is one small row. Samples
are not exchanged: each task sketches its own, and only the sketches meet. The rank of a reported value lies within
``rank_error(k)`` times the number of samples of the wanted rank (99 % of the time for one value); merged sketches keep that bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import bucket_start
from tidelog.operators.reports import PERCENTILES

K = 400


def rank_error(k: int = K) -> float:
    """Published bound of a KLL sketch on the normalized rank, one value, 99 % confidence."""
    return 2.296 / k**0.9021


def build(samples: DataFrame, kind: str = "kind", value: str = "ms", ts: str = "timestamp", k: int = K) -> DataFrame:
    """Per minute and kind: number of samples, largest one, sketch. Samples without a value or with NaN are left out."""
    number = F.col(value).cast("double")
    kept = samples.filter(number.isNotNull() & ~F.isnan(number))
    return kept.groupBy(bucket_start(F.col(ts), "1m").alias("time_bucket"), F.col(kind).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.max(number).alias("max"), F.kll_sketch_agg_double(number, k).alias("sketch")
    )


def merge(sketches: DataFrame, bucket: str | None = None, k: int = K) -> DataFrame:
    """Sketches of longer buckets, or of each kind over all time; late minutes and several batches merge alike."""
    keys = [F.col("kind")] if bucket is None else [bucket_start(F.col("time_bucket"), bucket).alias("time_bucket"), F.col("kind")]
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )


def _rank(percentile: int) -> Column:
    return F.lit(percentile / 100)


def summary(sketches: DataFrame) -> DataFrame:
    """The sketch of every row as its percentiles."""
    quantiles = [F.kll_sketch_get_quantile_double("sketch", _rank(p)).alias(f"p{p}") for p in PERCENTILES]
    return sketches.select(*[c for c in sketches.columns if c not in ("max", "sketch")], *quantiles, "max")


def within_error(summaries: DataFrame, samples: DataFrame, kind: str = "kind", value: str = "ms", k: int = K) -> DataFrame:
    """Per kind and percentile: is the exact rank of the reported value as near to the wanted one as ``rank_error`` says?

    Counts the samples below and up to each reported value; the values (a few per kind) go to the samples, which stay where they are.
    """
    wanted = summaries.select(
        "kind", "n", F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{p}").alias("reported")) for p in PERCENTILES]))
    )
    number = F.col(value).cast("double")
    given = samples.filter(number.isNotNull() & ~F.isnan(number)).select(F.col(kind).alias("kind"), number.alias("value"))
    counted = (
        given.join(F.broadcast(wanted), "kind")
        .groupBy("kind", "n", "p", "reported")
        .agg(F.count_if(F.col("value") < F.col("reported")).alias("below"), F.count_if(F.col("value") <= F.col("reported")).alias("upto"))
    )
    slack = F.ceil(F.lit(rank_error(k)) * F.col("n")) + 1
    rank = F.col("p") / 100 * F.col("n")
    return counted.select(
        "kind", "n", "p", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("within")
    )
