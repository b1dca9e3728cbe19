"""Progress of running streams, and ingest that paces itself by it.

A listener notes what Spark reports of every finished micro-batch. From the time that a batch took follows how many files
the next ones may bring to stay near a wanted duration; the source holds back the rest.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidelog.streaming.ingest_stream import start_ingest

# Fixed value: progress reports that are kept, the oldest go.
MOST_REPORTS = 10_000


@dataclass(frozen=True)
class Report:
    run: str
    batch: int
    started: str
    rows: int
    seconds: float


@dataclass
class ProgressLog(StreamingQueryListener):
    """Reports of the micro-batches that had rows, in the order in which they came."""

    reports: list[Report] = field(default_factory=list)
    ended: set[str] = field(default_factory=set)
    news: threading.Condition = field(default_factory=threading.Condition)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self.news:
            if p.numInputRows:
                self.reports.append(Report(str(p.runId), p.batchId, p.timestamp, p.numInputRows, p.batchDuration / 1000))
                del self.reports[:-MOST_REPORTS]
            self.news.notify_all()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, query: StreamingQuery) -> list[Report]:
        return [r for r in self.reports if r.run == str(query.runId)]

    def first_report(self, query: StreamingQuery) -> Report | None:
        """The first report of a query; None if it ends without one."""
        run = str(query.runId)
        with self.news:
            self.news.wait_for(lambda: self.of(query) or run in self.ended)
            return next(iter(self.of(query)), None)

    def wait(self, query: StreamingQuery) -> None:
        """Until the query has ended and everything about it has been told."""
        query.awaitTermination()
        with self.news:
            self.news.wait_for(lambda: str(query.runId) in self.ended)


@dataclass(frozen=True)
class Paced:
    """What was reported, and the number of files that a batch of each run was allowed."""

    reports: list[Report]
    limits: dict[str, int]


def next_limit(files: int, report: Report, seconds: float, most: int) -> int:
    """How many files a batch may bring to take about so many seconds, by one that brought ``files``."""
    return max(1, min(most, int(files * seconds / max(report.seconds, 0.001))))


def ingest_paced(
    spark: SparkSession,
    bodies: Callable[[int], DataFrame],
    table_path: str,
    checkpoint: str,
    seconds: float,
    first_files: int = 1,
    most_files: int = 1000,
    adjustments: int = 3,
    **options,
) -> Paced:
    """Ingest all that is available in batches of about ``seconds``; ``bodies(files)`` opens the stream with a limit per batch.

    After the first batch of a run the limit is set anew from what that batch took, until it stays within a factor of two or
    was set ``adjustments`` times. A batch that is stopped for this comes again under its number.
    """
    log, limit, limits = ProgressLog(), first_files, {}
    spark.streams.addListener(log)
    try:
        for left in range(adjustments, -1, -1):
            query = start_ingest(bodies(limit), table_path, checkpoint, **options)
            limits[str(query.runId)] = limit
            report = log.first_report(query) if left else None
            wanted = limit if report is None else next_limit(limit, report, seconds, most_files)
            if limit / 2 <= wanted <= limit * 2:
                log.wait(query)
                break
            query.stop()
            log.wait(query)
            limit = wanted
    finally:
        spark.streams.removeListener(log)
    return Paced(list(log.reports), limits)


def batch_rates(spark: SparkSession, paced: Paced) -> DataFrame:
    """Per finished batch: run, batch, timestamp, rows, seconds, rate, and the files it was allowed."""
    rows = [(r.run, r.batch, r.started, r.rows, r.seconds, paced.limits[r.run]) for r in paced.reports]
    told = spark.createDataFrame(rows, "run string, batch long, started string, rows long, seconds double, files int")
    return told.select(
        "run", "batch", F.col("started").cast("timestamp").alias("timestamp"), "rows", "seconds",
        (F.col("rows") / F.nullif(F.col("seconds"), F.lit(0.0))).alias("rate"), "files",
    )
