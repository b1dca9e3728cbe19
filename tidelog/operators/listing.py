"""Newest-first listing, keyset pages, page index and ordered export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.cursors import cursor_token
from tidelog.functions.times import iso_micros
from tidelog.operators.positions import with_positions

# Page sizes, and the answer to one beyond them.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
BAD_SIZE = f"limit must be between 1 and {MAX_LIMIT}"


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(BAD_SIZE)
    return limit


def newest_first(logs: DataFrame) -> DataFrame:
    return logs.orderBy(F.col("timestamp").desc(), F.col("id").desc())


def newest(logs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest rows: a bounded heap per partition, no full sort."""
    return newest_first(logs).limit(check_limit(limit))


def entry_columns(logs: DataFrame) -> list[Column]:
    """A row as it is handed out: id as text, time with microseconds, attributes as JSON text."""
    attributes = F.col("attributes")
    if isinstance(logs.schema["attributes"].dataType, T.VariantType):
        attributes = F.to_json(attributes)
    return [
        F.col("id").cast("string").alias("id"),
        iso_micros(F.col("timestamp")).alias("timestamp"),
        F.col("level"),
        F.col("service"),
        F.col("message"),
        F.coalesce(attributes, F.lit("{}")).alias("attributes"),
    ]


def as_entries(logs: DataFrame) -> DataFrame:
    return logs.select(*entry_columns(logs))


def page(logs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page with ``page_row`` (1-based) and ``next_cursor``: set on the last row if more rows follow.

    One row more than the page is fetched to learn whether there is a next page.
    The windows see at most 1001 rows.
    """
    check_limit(limit)
    fetched = newest_first(logs).limit(limit + 1)
    in_order = Window.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    numbered = fetched.withColumn("page_row", F.row_number().over(in_order)).withColumn(
        "_fetched", F.count(F.lit(1)).over(Window.partitionBy())
    )
    is_last = (F.col("page_row") == limit) & (F.col("_fetched") > limit)
    return (
        numbered.filter(F.col("page_row") <= limit)
        .withColumn("next_cursor", F.when(is_last, cursor_token(F.col("timestamp"), F.col("id"))))
        .drop("_fetched")
    )


def next_cursor(logs: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One row: the token of the next page, or NULL."""
    return page(logs, limit).agg(F.max("next_cursor").alias("next_cursor"))


@dataclass(frozen=True)
class Page:
    logs: list[dict]
    next_cursor: str | None


def fetch_pages(logs: DataFrame, limit: int = DEFAULT_LIMIT, most: int = 1) -> list[Page]:
    """The first pages on the driver, found together: at most ``most`` of them, with one row more. The first may be empty."""
    check_limit(limit)
    rows = (
        newest_first(logs)
        .limit(limit * most + 1)
        .select(
            cursor_token(F.col("timestamp"), F.col("id")).alias("token"),
            F.struct(*entry_columns(logs)).alias("entry"),
        )
        .collect()
    )
    pages = []
    for start in range(0, max(1, min(len(rows), limit * most)), limit):
        kept = rows[start : start + limit]
        more = len(rows) > start + limit
        pages.append(Page([row["entry"].asDict() for row in kept], kept[-1]["token"] if more else None))
    return pages


def fetch_page(logs: DataFrame, limit: int = DEFAULT_LIMIT) -> Page:
    """A page on the driver (at most 1001 rows)."""
    return fetch_pages(logs, limit)[0]


def positioned(logs: DataFrame) -> DataFrame:
    """``timestamp``, ``id`` and the 0-based place of every row in newest-first order."""
    keys = logs.select("timestamp", "id")
    return with_positions(keys, ("timestamp", False), ("id", False))


def page_index(logs: DataFrame, page_size: int = DEFAULT_LIMIT) -> DataFrame:
    """All pages of the whole result: number, first and last key, row count.

    Only the sort keys are shuffled. A page's rows are neighbours in the sorted
    partitions, so the aggregation combines them before its exchange.
    """
    rows = positioned(logs)
    place = F.col("position") % page_size
    closes = (place == page_size - 1) | (F.col("position") == F.col("total") - 1)
    return (
        rows.groupBy(F.expr(f"position DIV {int(page_size)}").alias("page_no"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("timestamp").alias("first_timestamp"),
            F.max(F.when(place == 0, F.col("id"))).alias("first_id"),
            F.min("timestamp").alias("last_timestamp"),
            F.max(F.when(closes, F.col("id"))).alias("last_id"),
        )
    )


def ordered(logs: DataFrame) -> DataFrame:
    """The whole result in newest-first order, range-partitioned, for export.

    Written out, the files follow each other in order, without gaps or repeats.
    """
    keys = [F.col("timestamp").desc(), F.col("id").desc()]
    return logs.repartitionByRange(*keys).sortWithinPartitions(*keys)
