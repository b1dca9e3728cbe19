"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The six columns of a log record.
LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.VariantType()),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.names

# One row per received entry, and one for each refused or empty envelope. Accepted rows fill the log columns, rejected
# rows ``reason`` and ``entry``. ``content`` is the hash of an accepted row as it was received. ``origin`` is the batch that brought the row, also after compaction.
ENTRY_SCHEMA = T.StructType(
    LOG_SCHEMA.fields
    + [
        T.StructField("origin", T.StringType()),
        T.StructField("batch_key", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("entry", T.StringType()),
        T.StructField("content", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("log_date", T.DateType()),
    ]
)

ROLLUP_KEYS = ["time_bucket", "service", "level"]
ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("time_bucket", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("log_count", T.LongType()),
        T.StructField("content_low", T.LongType()),
        T.StructField("content_high", T.LongType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("grain", T.StringType()),
        T.StructField("bucket_date", T.DateType()),
    ]
)
