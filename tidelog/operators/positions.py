"""Global row positions in a total order, without pulling the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidelog.session import shared_dir

# monotonically_increasing_id(): partition number above this many bits of row number.
_ROW_BITS = 33


def in_ranges(rows: DataFrame, *order: str | tuple[str, bool], seen: Observation | None = None, **measures: Column) -> DataFrame:
    """The rows in ranges of a total order, with their partition ``_part`` and a number ``_slot`` that grows with the order.

    ``seen`` is told the ``measures`` of all rows by the job that ranges them.
    """
    keys = []
    for item in order:
        name, ascending = item if isinstance(item, tuple) else (item, True)
        keys.append(F.col(name).asc() if ascending else F.col(name).desc())
    shared_dir(rows.sparkSession)
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if seen is not None:
        ranged = ranged.observe(seen, *[measure.alias(name) for name, measure in measures.items()])
    placed = ranged.checkpoint().withColumn("_slot", F.monotonically_increasing_id())
    return placed.withColumn("_part", F.shiftright("_slot", _ROW_BITS))


def with_positions(rows: DataFrame, *order: str | tuple[str, bool]) -> DataFrame:
    """Add 0-based ``position`` and the ``total`` row count.

    ``order`` holds column names, or ``(name, ascending)``. The order must be
    total (add an id or salt), which also lets range partitioning split a hot value.

    One range shuffle of ``rows``: pass narrow rows. The ranged rows are
    checkpointed, because range bounds are sampled anew by each evaluation and
    positions must be read off the same partitions that were counted.
    """
    placed = in_ranges(rows, *order)
    # One row per partition from here on, whatever the number of rows.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(Window.partitionBy()).alias("total"),
    )
    row_number = F.col("_slot") - F.shiftleft("_part", _ROW_BITS)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + row_number)
        .drop("_slot", "_part", "_offset")
    )
