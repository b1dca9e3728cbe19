"""The minute rollup: additive counts per (minute, service, level), and sums of row hashes beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import bucket_start
from tidelog.schema import ROLLUP_KEYS


def build(logs: DataFrame) -> DataFrame:
    """Counts of one batch, or of the whole log for a rebuild."""
    return logs.groupBy(
        bucket_start(F.col("timestamp"), "1m").alias("time_bucket"), "service", "level"
    ).agg(F.count(F.lit(1)).alias("log_count"))


# What is summed. The hash of a row enters with 26 bits in each of two sums, which hold 2^37 rows.
MEASURES = ("log_count", "content_low", "content_high")
_PART_BITS = 26


def content_hash() -> Column:
    """Hash of all that a row says: its id, time, level, service, message and attributes."""
    return F.xxhash64("id", "timestamp", "level", "service", "message", F.to_json("attributes"))


def _parts(value: Column) -> list[Column]:
    part = lambda shift: F.shiftrightunsigned(value, shift).bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return [part(0).alias("content_low"), part(_PART_BITS).alias("content_high")]


def row_measures(rows: DataFrame, value: Column, *keys: str) -> DataFrame:
    """What a row adds to its minute. The sums do not depend on the order of rows, count repeated rows, and add up like counts."""
    minute = bucket_start(F.col("timestamp"), "1m").alias("time_bucket")
    return rows.select(*keys, minute, "service", "level", F.lit(1).cast("bigint").alias("log_count"), *_parts(value))


def total(deltas: DataFrame, measures: tuple[str, ...] = ("log_count",)) -> DataFrame:
    """Current sums over all deltas. Late rows simply add to their old minute."""
    return deltas.groupBy(*ROLLUP_KEYS).agg(*[F.sum(m).alias(m) for m in measures])


def merge(*deltas: DataFrame) -> DataFrame:
    columns = [*ROLLUP_KEYS, "log_count"]
    return total(reduce(DataFrame.unionByName, [d.select(*columns) for d in deltas]))


def coarsen(rollup: DataFrame, bucket: str) -> DataFrame:
    """Minutes summed to a longer bucket, service and level kept."""
    return rollup.groupBy(
        bucket_start(F.col("time_bucket"), bucket).alias("time_bucket"), "service", "level"
    ).agg(F.sum("log_count").alias("log_count"))


def audit(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Keys whose count in the log and in the rollup differ, from either side.

    Both sides go through one aggregation on the same keys: one exchange instead
    of two aggregations and a full outer join.
    """
    minute = bucket_start(F.col("timestamp"), "1m").alias("time_bucket")
    raw = logs.select(minute, "service", "level", F.lit(1).cast("bigint").alias("raw"), F.lit(0).cast("bigint").alias("kept"))
    kept = rollup.select(*ROLLUP_KEYS, F.lit(0).cast("bigint").alias("raw"), F.col("log_count").cast("bigint").alias("kept"))
    return (
        raw.unionByName(kept)
        .groupBy(*ROLLUP_KEYS)
        .agg(F.sum("raw").alias("raw_count"), F.sum("kept").alias("rollup_count"))
        .filter(F.col("raw_count") != F.col("rollup_count"))
    )


def audit_content(logs: DataFrame, deltas: DataFrame) -> DataFrame:
    """Keys whose rows are not those that were counted: other numbers, or other sums of hashes at the same number.

    The hashes are taken anew from the rows. Finds a changed, replaced, lost or repeated row (but for a chance of 2^-52 a
    key); two changes of place within one key are none.
    """
    raw = row_measures(logs, content_hash()).select(F.lit(1).alias("side"), "*")
    sides = raw.unionByName(deltas.select(F.lit(-1).alias("side"), *ROLLUP_KEYS, *MEASURES))
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("log_count"))), F.lit(0))
    return (
        sides.groupBy(*ROLLUP_KEYS)
        .agg(of(1).alias("raw_count"), of(-1).alias("rollup_count"), *[F.sum(F.col("side") * F.col(m)).alias(m) for m in MEASURES])
        .filter((F.col("log_count") != 0) | (F.col("content_low") != 0) | (F.col("content_high") != 0))
        .select(*ROLLUP_KEYS, "raw_count", "rollup_count")
    )
