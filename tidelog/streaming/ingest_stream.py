"""Micro-batch ingest: each batch is validated, stored and counted as one unit.

No watermark and no de-duplication: rows may arrive arbitrarily late and add to
their old minute, and equal entries are stored as often as they come.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidelog.sources import paths
from tidelog.sources.log_table import LogTable


def _clock() -> datetime:
    return datetime.now(timezone.utc)


def _stream_name(spark: SparkSession, checkpoint: str) -> str:
    path = f"{checkpoint.rstrip('/')}/stream-name"
    if not paths.exists(spark, path):
        paths.write_text(spark, path, f"s{uuid.uuid4().hex}")
    return paths.read_text(spark, path).strip()


def start_ingest(
    envelopes: DataFrame,
    table_path: str,
    checkpoint: str,
    clock: Callable[[], datetime] = _clock,
    interval: str | None = None,
    max_service_len: int | None = None,
    stream: str | None = None,
    lookups: Iterable[str] = (),
) -> StreamingQuery:
    """Write a stream of envelopes ``(batch_key, body)`` to a log table.

    ``clock`` is read once per batch. Without ``interval`` all that is available
    is processed and the query ends; with it (``"10 seconds"``) it goes on.
    The stream's progress is recorded after the commit, so a batch that was
    interrupted comes again under its number. Numbers count within ``stream``, whose
    name is made once and kept beside the progress: another stream, or this one with
    a new checkpoint, adds its rows whatever numbers the table has seen. ``lookups``
    names the attributes whose hashes are kept beside the rows.
    """
    named = tuple(lookups)
    own = stream or _stream_name(envelopes.sparkSession, checkpoint)

    def store(batch: DataFrame, batch_id: int) -> None:
        table = LogTable(batch.sparkSession, table_path, lookups=named)
        table.ingest(batch, own, batch_id, clock(), max_service_len)

    writer = envelopes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if interval is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=interval).start()
