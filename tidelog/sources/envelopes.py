"""Reading request bodies: one per file, or one per line of text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import prepare


def read_envelopes(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    return _keyed(prepare(spark).read.format("text").option("wholetext", whole_files).load(path), whole_files)


def stream_envelopes(
    spark: SparkSession,
    path: str,
    whole_files: bool = True,
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """Unread files wait at the source; ``max_files`` or ``max_bytes`` bound one micro-batch."""
    reader = prepare(spark).readStream.format("text").option("wholetext", whole_files)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _keyed(reader.load(path), whole_files)


def _keyed(bodies: DataFrame, whole_files: bool) -> DataFrame:
    """``batch_key`` tells where a body came from: its file, and for lines the hash of the text."""
    origin = F.col("_metadata.file_path")
    key = origin if whole_files else F.concat_ws("#", origin, F.hex(F.xxhash64("value")))
    return bodies.select(key.alias("batch_key"), F.col("value").alias("body"))
