"""The stored log: Parquet rows by batch and UTC day, rollup deltas, commit records.

    rows/batch_id=STREAM-N/outcome=accepted|rejected|empty/log_date=D/
    rollup/batch_id=STREAM-N/version=V/grain=1m|1h|1d/bucket_date=D/
    commits/STREAM-N.V.R
    ids/PART.STREAM.claim|own

A batch belongs to a stream and has a number that grows within it. It is written whole, then committed by one small record.
Readers take committed batches only, so rows and rollup become visible together; a batch that was interrupted is
overwritten by its replay, and a number that its stream has committed before is not written again; a lower number that it
never committed is refused. Any number of streams write at once, each by one writer; they have parts of the id space of
their own. A record lists the days that are visible: version V counts rebuilt deltas, revision R expiries. Maintenance
(compaction, rebuild, expiry) runs one at a time, beside the streams.

A batch's delta holds the sums of its minutes, hours and days, and of the hashes of its rows, as the audit compares them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from datetime import date, datetime, time, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions import lookups as L
from tidelog.functions.cursors import Cursor, Walk
from tidelog.functions.times import utc
from tidelog.operators import aggregate, hierarchy, ingest, listing, retention, rollup
from tidelog.operators.filters import LogFilter, last_day_before
from tidelog.schema import ENTRY_SCHEMA, LOG_COLUMNS, ROLLUP_SCHEMA
from tidelog.session import prepare, settings
from tidelog.sources import id_space, paths

# Ids: every scan task of a batch has a range of 2^22 numbers. A task with more rows goes on in further ranges.
ID_ROW_BITS = 22
_SLOT_ROW_BITS = 33
_MOST_TASKS = 1 << 20

# Shuffled bytes that one task sorts and writes. Rows take some ten times as much in the memory of the
# sort, so this decides what a task needs, whatever the size of the batch. With little data Spark still uses all cores.
FILE_BYTES = "32MB"

# Only what several scan tasks send to a partition can be split there, so after this many rows a scan task sends further rows
# of the same day elsewhere. Rejected and empty rows are those of a single day, the day of arrival, in any batch.
_ACCEPTED_RUN_BITS, _OTHER_RUN_BITS = 20, 18

# Batches below this many rows are merged by compaction; larger ones are left alone.
COMPACT_BELOW = 50_000_000

STREAM = re.compile(r"[A-Za-z0-9_]{1,64}")
MERGED = "merged"  # the stream of compaction

# More commit records than this are read by a Spark job instead of one by one.
_READ_SINGLY = 32

# A walk that goes on page after page reads ahead, twice as many pages each time, up to so many rows and about so many letters.
_AHEAD_ROWS = 16_000
_AHEAD_LETTERS = 16_000_000

# Times that carry file statistics, so that time bounds skip row groups.
_TIMES = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS"}

_known: dict[str, dict[str, Commit]] = {}  # commit records by table, and by name and time of their file


@dataclass(frozen=True)
class Commit:
    stream: str
    number: int
    version: int
    accepted: int
    rejected: int
    id_limit: int
    days: tuple[str, ...]  # of accepted rows
    rejected_days: tuple[str, ...]  # the day of their arrival, as for empty envelopes
    empty_days: tuple[str, ...]
    delta_days: tuple[str, ...] = ()
    revision: int = 0
    replaces: tuple[str, ...] = ()  # batches that this one merged
    seen: dict[str, int] = field(default_factory=dict)  # highest number of each merged stream
    merged: dict[str, list[list[int]]] = field(default_factory=dict)  # ranges of the merged numbers of each stream
    limits: dict[str, int] = field(default_factory=dict)  # end of the ids of each merged stream
    lookups: tuple[str, ...] = ()  # attributes whose hashes lie beside the rows

    def numbers(self, stream: str) -> list[list[int]]:
        """Ranges of the numbers of a stream that this record commits; older records only know the highest merged one."""
        own = [[self.number, self.number]] if self.stream == stream else []
        return own + self.merged.get(stream, [[0, self.seen[stream]]] if stream in self.seen else [])

    @property
    def streams(self) -> set[str]:
        return {*self.merged, *self.seen} if self.stream == MERGED else {self.stream}

    def begins(self, seen: dict[str, int]) -> bool:
        """Does it hold a batch that is among those seen?"""
        return any(low <= seen.get(s, -1) for s in self.streams for low, _ in self.numbers(s))

    def ends_after(self, seen: dict[str, int]) -> bool:
        return any(high > seen.get(s, -1) for s in self.streams for _, high in self.numbers(s))

    def end_of_ids(self, stream: str) -> int:
        return self.id_limit if self.stream == stream else self.limits.get(stream, 0)

    @property
    def batch(self) -> str:
        return f"{self.stream}-{self.number}"

    @property
    def first_date(self) -> date | None:
        return date.fromisoformat(self.days[0]) if self.days else None

    @property
    def last_date(self) -> date | None:
        return date.fromisoformat(self.days[-1]) if self.days else None


@dataclass(frozen=True)
class Snapshot:
    """What one call sees of the table: the newest record of every batch, also of merged ones."""

    records: list[Commit]

    @property
    def live(self) -> list[Commit]:
        gone = {b for c in self.records for b in c.replaces}
        return [c for c in self.records if c.batch not in gone]

    @property
    def streams(self) -> set[str]:
        return {s for c in self.records for s in c.streams}


@dataclass
class _Ahead:
    """Pages of a walk by their places, read together with one that was asked for; they hold while the batches of the walk stay as they are."""

    asked: tuple[LogFilter, int]
    shown: list[Commit]
    most: int
    pages: dict[str | None, listing.Page]
    end: str | None  # the place after the last of them
    longest: int  # letters of the longest page so far

    def follows(self, asked: tuple[LogFilter, int], place: str | None) -> bool:
        return place is not None and self.asked == asked and (place == self.end or place in self.pages)


class LogTable:
    def __init__(self, spark: SparkSession, path: str, file_bytes: str = FILE_BYTES, lookups: Iterable[str] = ()):
        """``lookups`` names attributes whose values scans of later batches can look up; readers need not name them."""
        self.spark = prepare(spark)
        self.path = path.rstrip("/")
        self.file_bytes = file_bytes
        self.lookups = tuple(dict.fromkeys(lookups))
        self._ahead: _Ahead | None = None

    # -- reading ---------------------------------------------------------------

    def commits(self) -> list[Commit]:
        """Live commits by stream and number."""
        return self.snapshot().live

    def snapshot(self) -> Snapshot:
        """One listing of the records; only those not read before are opened."""
        folder = f"{self.path}/commits"
        known = _known.setdefault(self.path, {})
        present = {n: stamp for n, stamp in paths.stamped_names(self.spark, folder).items() if n[0] not in "._"}
        new = [n for n, stamp in present.items() if stamp not in known]
        if len(new) > _READ_SINGLY:
            lines = self.spark.read.text([f"{folder}/{n}" for n in new]).select("value", "_metadata.file_name").collect()
            known.update({present[r["file_name"]]: _parse(r["value"]) for r in lines})
        else:
            known.update({present[n]: _parse(paths.read_text(self.spark, f"{folder}/{n}")) for n in new})
        newest: dict[str, Commit] = {}
        for commit in (known[stamp] for stamp in present.values()):
            known_as = newest.get(commit.batch)
            if known_as is None or (known_as.version, known_as.revision) < (commit.version, commit.revision):
                newest[commit.batch] = commit
        return Snapshot(sorted(newest.values(), key=lambda c: (c.stream, c.number)))

    def rows(self, where: LogFilter | None = None) -> DataFrame:
        """Accepted rows of committed batches, with ``log_date`` for partition pruning.

        Only the folders of days in the range of ``where`` are opened.
        """
        found = self._accepted(self.snapshot(), where)
        return found if where is None else where.apply(found)

    def rejects(self) -> DataFrame:
        """Rejected entries; a refused envelope has no ``index`` and no ``entry``."""
        found = self._entries(self.snapshot(), "rejected")
        return found.select(F.col("origin").alias("batch"), "batch_key", "index", "reason", "entry")

    def envelopes(self) -> DataFrame:
        """Per stored envelope its status, the error of a refused one, and the number of accepted entries."""
        now = self.snapshot()
        parts = [
            self._entries(now, outcome).select(
                F.col("origin").alias("batch"),
                "batch_key",
                F.lit(int(outcome == "accepted")).alias("accepted"),
                (F.col("reason") if outcome == "rejected" else F.lit(None).cast("string")).alias("reason"),
                "index",
            )
            for outcome in ("accepted", "rejected", "empty")
        ]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2])
        counted = every.groupBy("batch", "batch_key").agg(
            F.sum("accepted").alias("accepted"), F.max(F.when(F.col("index").isNull(), F.col("reason"))).alias("error")
        )
        status = (
            F.when(F.col("error").isNotNull(), ingest.REFUSED)
            .when(F.col("accepted") > 0, ingest.OK)
            .otherwise(ingest.REJECTED)
        )
        return counted.select("batch", "batch_key", status.alias("status"), "error", "accepted")

    def rollup_deltas(self, where: LogFilter | None = None, grain: str = "1m") -> DataFrame:
        """Sums per minute (or hour, day) of every batch."""
        return self._deltas(self.snapshot(), where, grain=grain)

    def rollup(self) -> DataFrame:
        return rollup.total(self.rollup_deltas())

    def audit(self) -> DataFrame:
        """Minutes in which the stored deltas differ from the stored rows; days without rows by retention are left out."""
        now = self.snapshot()
        return rollup.audit(self._accepted(now), rollup.total(self._kept_deltas(now)))

    def audit_content(self) -> DataFrame:
        """Minutes in which the stored rows are not those that were counted, also where their number is the same."""
        now = self.snapshot()
        return rollup.audit_content(self._accepted(now), self._kept_deltas(now))

    def _kept_deltas(self, now: Snapshot) -> DataFrame:
        """The deltas of the days that have rows."""
        return self._deltas(Snapshot([_with_deltas(c, [d for d in c.delta_days if d in set(c.days)]) for c in now.live]), None)

    def _spans(self, now: Snapshot, where: LogFilter) -> Iterator[LogFilter]:
        """The filter on growing spans of the newest days, the whole range last."""
        days = [d for c in now.live for d in _in_range(c.days, where)]
        if days:
            first, last = (date.fromisoformat(d).toordinal() for d in (min(days), max(days)))
            span = 1
            while last - span >= first:
                start = datetime.combine(date.fromordinal(last - span + 1), time(), timezone.utc)
                yield replace(where, since=start)
                span *= 8
        yield where

    def newest(self, where: LogFilter, limit: int = listing.DEFAULT_LIMIT) -> DataFrame:
        """The newest matching rows, from the newest days that hold enough of them."""
        now, enough = self.snapshot(), listing.check_limit(limit)
        found = None
        for part in self._spans(now, where):
            found = part.apply(self._accepted(now, part))
            if part is not where and found.limit(enough).count() == enough:
                break
        return listing.newest(found, limit)

    def page(self, where: LogFilter, limit: int = listing.DEFAULT_LIMIT) -> listing.Page:
        """A page of the stored log on the driver; its cursor goes into the filter of the next."""
        return self._page(self.snapshot(), where, limit)

    def _page(self, now: Snapshot, where: LogFilter, limit: int) -> listing.Page:
        return self._pages(now, where, limit)[0]

    def _pages(
        self, now: Snapshot, where: LogFilter, limit: int, seen: dict[str, int] | None = None, most: int = 1
    ) -> list[listing.Page]:
        """One page or more: those that the newest days that fill one hold."""
        for part in self._spans(now, where):
            pages = listing.fetch_pages(part.apply(self._accepted(now, part, seen)), limit, most)
            full = [p for p in pages if p.next_cursor is not None]  # and more rows follow
            if full and part is not where:
                return full
        return pages

    def walk(self, where: LogFilter, limit: int = listing.DEFAULT_LIMIT, place: str | None = None) -> listing.Page:
        """A page of a walk that shows the table as it was at the first page, whatever is stored or merged meanwhile.

        ``place`` is the ``next_cursor`` of the page before. It names the last batch of every stream that the walk began with;
        rows of later batches, also those with older times, are left for another walk. A walk that goes on reads ahead.
        """
        now, asked = self.snapshot(), (where, listing.check_limit(limit))
        if place is None:
            seen = {s: max(high for c in now.live for _, high in c.numbers(s)) for s in now.streams}
        else:
            found = Walk.decode(place)
            if found is None:
                raise ValueError("not a place in a walk")
            seen, where = found.seen, replace(where, cursor=found.cursor)
        shown = [c for c in now.live if c.begins(seen)]
        ahead = self._ahead
        if ahead is None or ahead.shown != shown or ahead.asked != asked or place not in ahead.pages:
            ahead = self._ahead = self._read_ahead(asked, shown, where, seen, place)
        return ahead.pages.pop(place)

    def _read_ahead(
        self, asked: tuple[LogFilter, int], shown: list[Commit], where: LogFilter, seen: dict[str, int], place: str | None
    ) -> _Ahead:
        """The page at a place, and further ones if the walk came here page by page. One page after another, each
        would cost a scan of its days."""
        before, limit = self._ahead, asked[1]
        most, longest = 1, 0
        if before is not None and before.follows(asked, place):
            longest = before.longest
            bound = min(_AHEAD_ROWS // limit, _AHEAD_LETTERS // max(1, longest))
            most = max(1, min(bound, 2 * before.most if place == before.end else before.most))
        pages: dict[str | None, listing.Page] = {}
        for page in self._pages(Snapshot(shown), where, limit, seen, most):
            following = page.next_cursor and Walk(Cursor.decode(page.next_cursor), seen).encode()
            longest = max(longest, sum(len(v or "") for entry in page.logs for v in entry.values()))
            pages[place] = listing.Page(page.logs, following)
            place = following
        return _Ahead(asked, shown, most, pages, place, longest)

    def counts(
        self, where: LogFilter, bucket: str, group_by: str | None = None, exact: bool = False
    ) -> DataFrame:
        """Counts per bucket, from the rollup where it can answer. Only the sides that are read are opened."""
        now = self.snapshot()
        if not aggregate.rollup_answers(where):
            counted = aggregate.from_logs(where.apply(self._accepted(now, where)), LogFilter(), bucket, group_by)
            return aggregate.in_order(counted)
        if exact and (where.since is None or where.until is None):
            raise ValueError("exact counts need since and until")
        counted = hierarchy.counts(
            lambda grain, span: self._deltas(now, span, grain=grain),
            where,
            bucket,
            group_by,
            (lambda span: self._accepted(now, span)) if exact else None,
        )
        return aggregate.in_order(counted)

    def _accepted(self, now: Snapshot, where: LogFilter | None = None, seen: dict[str, int] | None = None) -> DataFrame:
        """Accepted rows; with ``seen``, those of no later batch of any stream.

        Batches that keep hashes of wanted attributes are scanned for these. The filter itself is left to the caller.
        """
        wanted = dict(where.attrs) if where is not None else {}
        groups: dict[tuple[str, ...], list[Commit]] = {}
        for c in now.live:
            groups.setdefault(tuple(k for k in wanted if k in c.lookups), []).append(c)
        parts = []
        for keys, commits in groups.items():
            part = self._entries(now, "accepted", where, commits, keys)
            for k in keys:
                part = part.filter(L.could_equal(k, wanted[k]))
            parts.append(part.select(*ENTRY_SCHEMA.names))
        rows = reduce(DataFrame.unionByName, parts) if parts else self._entries(now, "accepted")
        if seen is not None and any(c.ends_after(seen) for c in now.live):  # merged with later ones
            stream, number = F.substring_index("origin", "-", 1), F.substring_index("origin", "-", -1).cast("bigint")
            rows = rows.filter(F.coalesce(number <= F.element_at(_as_map(seen), stream), F.lit(False)))
        return rows.select(*LOG_COLUMNS, "log_date")

    def _entries(
        self,
        now: Snapshot,
        outcome: str,
        where: LogFilter | None = None,
        commits: list[Commit] | None = None,
        keys: tuple[str, ...] = (),
    ) -> DataFrame:
        """Rows of the batches, from the folders of the days in range, with the hashes of some attributes."""
        folders = []
        for c in now.live if commits is None else commits:
            days = {"accepted": c.days, "rejected": c.rejected_days, "empty": c.empty_days}[outcome]
            folders += _folders(c, f"batch_id={c.batch}/outcome={outcome}", "log_date", _in_range(days, where), days)
        return self._read("rows", folders, L.extended(ENTRY_SCHEMA, keys))

    def _deltas(
        self, now: Snapshot, where: LogFilter | None, commits: list[Commit] | None = None, grain: str = "1m"
    ) -> DataFrame:
        folders = []
        for c in now.live if commits is None else commits:
            wanted = _in_range(c.delta_days, where)
            folders += _folders(c, _delta_folder(c), f"grain={grain}/bucket_date", wanted, c.delta_days)
        return self._read("rollup", folders, ROLLUP_SCHEMA).filter(F.col("grain") == grain)

    def _read(self, area: str, folders: list[str], schema: T.StructType) -> DataFrame:
        base = f"{self.path}/{area}"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])

    # -- writing ---------------------------------------------------------------

    def ingest(
        self,
        envelopes: DataFrame,
        stream: str,
        number: int,
        now: datetime,
        max_service_len: int | None = None,
    ) -> Commit:
        """Validate and store one batch of envelopes ``(batch_key, body)`` of a stream; a replay is a no-op."""
        opened = ingest.open_envelopes(envelopes)
        # A refused envelope, and an empty one, stays as one row without index and entry.
        entries = opened.select("batch_key", "problem", F.posexplode_outer("logs").alias("index", "entry"))
        validated = ingest.validate_entries(entries, now, max_service_len)
        empty = F.col("index").isNull() & F.col("problem").isNull()
        judged = validated.withColumn("empty", empty).withColumn("reason", F.coalesce("problem", "reason"))
        return self._store(judged, stream, number, utc(now).date())

    def append(self, logs: DataFrame, stream: str, number: int) -> Commit:
        """Store rows known to be valid: the log columns without id."""
        nothing = F.lit(None)
        return self._store(
            logs.select(
                *[c for c in LOG_COLUMNS if c != "id"],
                nothing.cast("string").alias("batch_key"),
                nothing.cast("int").alias("index"),
                nothing.cast("string").alias("reason"),
                nothing.cast("variant").alias("entry"),
                F.lit(False).alias("empty"),
            ),
            stream,
            number,
            None,
        )

    def _store(self, validated: DataFrame, stream: str, number: int, arrival: date | None) -> Commit:
        if not isinstance(stream, str) or not STREAM.fullmatch(stream) or stream == MERGED:
            raise ValueError("a batch needs the name of its stream: letters, digits and _")
        if number < 0:
            raise ValueError("batches of a stream are numbered from 0")
        records = self.snapshot().records
        stored = [(low, high, commit) for commit in records for low, high in commit.numbers(stream)]
        for low, high, commit in stored:
            if low <= number <= high:
                return commit
        last = max((high for _, high, _ in stored), default=-1)
        if number < last:
            raise ValueError(f"batch {number} of stream {stream} was never stored and comes after batch {last}")
        limit = max((c.end_of_ids(stream) for c in records), default=0)
        id_base = id_space.next_base(self.spark, f"{self.path}/ids", stream, limit)
        outcome = F.when(F.col("empty"), "empty").when(F.col("reason").isNull(), "accepted").otherwise("rejected")
        ok, refused = outcome == "accepted", outcome == "rejected"

        # Ids are given in scan order, before the exchange: entries of one envelope keep their order.
        row = F.col("_slot").bitwiseAND(F.lit((1 << _SLOT_ROW_BITS) - 1))
        ranges = F.shiftright("_slot", _SLOT_ROW_BITS) + F.shiftright(row, ID_ROW_BITS) * F.lit(_MOST_TASKS)
        within = row.bitwiseAND(F.lit((1 << ID_ROW_BITS) - 1))
        row_id = F.shiftleft(ranges, ID_ROW_BITS) + within + F.lit(id_base)
        numbered = validated.withColumn("_slot", F.monotonically_increasing_id()).withColumn("id", row_id.cast("bigint")).select(
            "id",
            *[F.when(ok, F.col(c)).alias(c) for c in LOG_COLUMNS if c != "id"],
            F.when(ok, rollup.content_hash()).alias("content"),
            F.lit(f"{stream}-{number}").alias("origin"),
            "batch_key",
            "index",
            F.when(refused, F.col("reason")).alias("reason"),
            F.when(refused, F.to_json("entry")).alias("entry"),
            outcome.alias("outcome"),
            F.when(ok, F.to_date("timestamp")).otherwise(F.lit(arrival)).alias("log_date"),
        )
        seen = self._write_rows(numbered, f"{stream}-{number}")
        limit = id_base
        if seen["accepted"]:
            limit = max(id_base, ((seen["max_id"] >> ID_ROW_BITS) + 1) << ID_ROW_BITS)
        commit = Commit(
            stream, number, 0, seen["accepted"], seen["rejected"], limit, *self._days_of(f"{stream}-{number}"),
            lookups=self.lookups,
        )
        written = self._entries(Snapshot([commit]), "accepted")
        return self._finish(commit, rollup.row_measures(written, F.col("content")))

    def _write_rows(self, entries: DataFrame, batch: str) -> dict[str, int]:
        """All rows of a batch in one pass over the input; their numbers by outcome, and the highest id.

        Rebalancing by day gives files of a good size: small days are gathered,
        a hot day is split. Within a file rows are sorted for min/max pruning.
        """
        counted = Observation()
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _SLOT_ROW_BITS) - 1))
        run = F.when(F.col("outcome") == "accepted", F.shiftright(row, _ACCEPTED_RUN_BITS)).otherwise(F.shiftright(row, _OTHER_RUN_BITS))
        hashes = {L.column_name(k): L.stored_hash(F.col("attributes"), k) for k in self.lookups}
        laid_out = (
            entries.withColumns(hashes)
            .withColumn("_run", run)
            .hint("rebalance", "outcome", "log_date", "_run")
            .drop("_run")
            .sortWithinPartitions("outcome", "log_date", "service", "level", "timestamp")
            .observe(
                counted,
                F.count_if(F.col("outcome") == "accepted").alias("accepted"),
                F.count_if(F.col("outcome") == "rejected").alias("rejected"),
                F.max(F.when(F.col("outcome") == "accepted", F.col("id"))).alias("max_id"),
            )
        )
        with settings(self.spark, self._writing()):
            (
                laid_out.write.mode("overwrite")
                .options(**L.writer_options(["service", *hashes]))
                .partitionBy("outcome", "log_date")
                .parquet(f"{self.path}/rows/batch_id={batch}")
            )
        return counted.get

    def _writing(self) -> dict[str, str]:
        return {
            **_TIMES,
            "spark.sql.adaptive.enabled": "true",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": self.file_bytes,
        }

    def _days_of(self, batch: str) -> list[tuple[str, ...]]:
        """Days of accepted rows, rejected ones and empty envelopes, as the folders have them."""
        return [self._days_in(f"rows/batch_id={batch}/outcome={o}", "log_date") for o in ("accepted", "rejected", "empty")]

    def _days_in(self, folder: str, column: str) -> tuple[str, ...]:
        names = paths.names(self.spark, f"{self.path}/{folder}")
        return tuple(sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{column}=")))

    def _finish(self, commit: Commit, delta: DataFrame) -> Commit:
        """Write the rollup delta in all its grains, then the commit record."""
        self._write_delta(commit, delta)
        commit = replace(commit, delta_days=self._days_in(f"rollup/{_delta_folder(commit, '1m')}", "bucket_date"))
        self._write_record(commit)
        return commit

    def _write_delta(self, commit: Commit, delta: DataFrame) -> None:
        """One file per day and task; small deltas are one task."""
        gathered = {**self._writing(), "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
        with settings(self.spark, gathered):
            (
                hierarchy.levels(delta, measures=rollup.MEASURES)
                .withColumn("bucket_date", F.to_date("time_bucket"))
                .sortWithinPartitions("grain", "bucket_date", "service", "level", "time_bucket")
                .write.mode("overwrite")
                .partitionBy("grain", "bucket_date")
                .parquet(f"{self.path}/rollup/{_delta_folder(commit)}")
            )

    def _write_record(self, commit: Commit) -> None:
        paths.write_text(self.spark, f"{self.path}/commits/{_record_name(commit)}", json.dumps(asdict(commit)))

    # -- maintenance -----------------------------------------------------------

    def compact(self, below: int = COMPACT_BELOW) -> Commit | None:
        """Merge the live batches with fewer rows than ``below`` into one.

        Large batches stay, so the work follows the new data. The deltas of the
        merged batches are summed as they are: they may hold days whose rows are gone.
        """
        now = self.snapshot()
        small = [c for c in now.live if c.accepted < below]
        if len(small) < 2:
            return None
        sides = [self._entries(now, o, commits=small) for o in ("accepted", "rejected", "empty")]
        seen: dict[str, int] = {}
        for c in small:
            for stream, number in [(c.stream, c.number), *c.seen.items()]:
                seen[stream] = max(number, seen.get(stream, -1))
        merged = {stream: _ranges([r for c in small for r in c.numbers(stream)]) for stream in seen}
        limits = {stream: max(c.end_of_ids(stream) for c in small) for stream in seen}
        number = max((c.number for c in now.records if c.stream == MERGED), default=-1) + 1
        name = f"{MERGED}-{number}"
        counted = self._write_rows(sides[0].unionByName(sides[1]).unionByName(sides[2]).drop("batch_id"), name)
        commit = Commit(
            stream=MERGED,
            number=number,
            version=0,
            accepted=counted["accepted"],
            rejected=counted["rejected"],
            id_limit=0,
            **dict(zip(("days", "rejected_days", "empty_days"), self._days_of(name))),
            replaces=tuple(sorted(c.batch for c in small)),
            seen=seen,
            merged=merged,
            limits=limits,
            lookups=self.lookups,
        )
        return self._finish(commit, rollup.total(self._deltas(now, None, small), measures=rollup.MEASURES))

    def rebuild_rollup(self) -> None:
        """Derive all deltas anew from the stored rows, in one job; each takes effect with its new commit record.

        Days whose rows are gone by retention keep the deltas they have.
        """
        now = self.snapshot()
        if not now.live:
            return
        version = max(c.version for c in now.records) + 1
        unfinished = paths.matching(self.spark, f"{self.path}/rollup/batch_id=*/version={version}")
        paths.each(lambda folder: paths.remove(self.spark, folder), unfinished)
        built = rollup.row_measures(self._entries(now, "accepted"), F.col("content"), "batch_id")
        kept = [_with_deltas(c, [d for d in c.delta_days if d not in set(c.days)]) for c in now.live]
        if any(c.delta_days for c in kept):
            built = built.unionByName(self._deltas(Snapshot(kept), None).select(*built.columns))
        built = hierarchy.levels(built, "batch_id", measures=rollup.MEASURES)
        with settings(self.spark, self._writing()):
            (
                built.withColumn("version", F.lit(version))
                .withColumn("bucket_date", F.to_date("time_bucket"))
                .hint("rebalance", "batch_id", "bucket_date")
                .sortWithinPartitions("batch_id", "grain", "bucket_date", "service", "level", "time_bucket")
                .write.mode("append")
                .partitionBy("batch_id", "version", "grain", "bucket_date")
                .parquet(f"{self.path}/rollup")
            )

        def renew(commit: Commit) -> None:
            renewed = replace(commit, version=version)
            days = self._days_in(f"rollup/{_delta_folder(renewed, '1m')}", "bucket_date")
            self._write_record(replace(renewed, delta_days=days))

        paths.each(renew, now.live)

    def expire(
        self, now: datetime, days: int = retention.DEFAULT_DAYS, keep_rollups: bool = False
    ) -> list[date]:
        """Drop whole expired days of accepted, rejected and empty rows; no row is rewritten.

        A new record of each batch leaves the days out, rows and rollup together; then the folders of all batches go. What
        an interrupted call has left over is removed by ``vacuum``. Queries that opened the table before and still read
        those days will fail. Rows that arrive later for an expired day stay until the next call.
        """
        last = retention.last_expired_date(now, days).isoformat()
        dropped, records, folders = set(), [], []
        for c in self.snapshot().live:
            kept = {
                name: tuple(d for d in getattr(c, name) if d > last) for name in ("days", "rejected_days", "empty_days")
            }
            if not keep_rollups:
                kept["delta_days"] = tuple(d for d in c.delta_days if d > last)
            gone = {name: [d for d in getattr(c, name) if d <= last] for name in kept}
            if not any(gone.values()):
                continue
            records.append(replace(c, **kept, revision=c.revision + 1))
            folders += [f for name, expired in gone.items() for day in expired for f in _day_folders(c, name, day)]
            dropped |= {*gone["days"], *gone.get("delta_days", ())}
        paths.each(self._write_record, records)
        paths.each(lambda folder: paths.remove(self.spark, f"{self.path}/{folder}"), folders)
        return sorted(map(date.fromisoformat, dropped))

    def vacuum(self) -> list[str]:
        """Remove what no record shows any more: merged batches, replaced deltas, days half expired, old records.

        To be run when no query that opened the table before is left.
        """
        now = self.snapshot()
        live = {c.batch: c for c in now.live}
        gone = [c.batch for c in now.records if c.batch not in live]
        for batch in gone:
            for folder in (f"rows/batch_id={batch}", f"rollup/batch_id={batch}"):
                paths.remove(self.spark, f"{self.path}/{folder}")
        for batch, commit in live.items():
            for name in paths.names(self.spark, f"{self.path}/rollup/batch_id={batch}"):
                if name.startswith("version=") and name != f"version={commit.version}":
                    paths.remove(self.spark, f"{self.path}/rollup/batch_id={batch}/{name}")
            present = dict(zip(("days", "rejected_days", "empty_days"), self._days_of(batch)))
            deltas = [self._days_in(f"rollup/{_delta_folder(commit, g)}", "bucket_date") for g in hierarchy.GRAINS]
            present["delta_days"] = tuple({d for days in deltas for d in days})
            for name, days in present.items():
                for folder in (f for day in set(days) - set(getattr(commit, name)) for f in _day_folders(commit, name, day)):
                    paths.remove(self.spark, f"{self.path}/{folder}")
        kept = {_record_name(c) for c in live.values()}
        for name in paths.names(self.spark, f"{self.path}/commits"):
            if name not in kept and name[0] not in "._":
                paths.remove(self.spark, f"{self.path}/commits/{name}")
        return gone


def _as_map(seen: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in seen.items() for x in pair])


def _parse(text: str) -> Commit:
    values = json.loads(text)
    return Commit(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def _ranges(parts: list[list[int]]) -> list[list[int]]:
    """The same numbers in as few ranges as possible."""
    out: list[list[int]] = []
    for low, high in sorted(parts):
        if out and low <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _record_name(commit: Commit) -> str:
    return f"{commit.batch}.{commit.version}.{commit.revision}"


def _delta_folder(commit: Commit, grain: str | None = None) -> str:
    return f"batch_id={commit.batch}/version={commit.version}" + (f"/grain={grain}" if grain else "")


def _day_folders(commit: Commit, days: str, day: str) -> list[str]:
    """The folders of a day in one of the lists of days of a record."""
    if days == "delta_days":
        return [f"rollup/{_delta_folder(commit, g)}/bucket_date={day}" for g in hierarchy.GRAINS]
    outcome = {"days": "accepted", "rejected_days": "rejected", "empty_days": "empty"}[days]
    return [f"rows/batch_id={commit.batch}/outcome={outcome}/log_date={day}"]


def _with_deltas(commit: Commit, days: list[str]) -> Commit:
    """The record with some of its delta days only."""
    if len(days) == len(commit.delta_days):
        return commit
    return replace(commit, delta_days=tuple(days), revision=commit.revision + 1)


def _folders(commit: Commit, base: str, column: str, wanted: list[str], days: tuple[str, ...]) -> list[str]:
    """The folder above all days where that shows the same: none is left out, and none was expired."""
    if wanted and len(wanted) == len(days) and not commit.revision:
        return [base]
    return [f"{base}/{column}={d}" for d in wanted]


def _in_range(days: tuple[str, ...], where: LogFilter | None) -> list[str]:
    """The days that the time bounds of a filter allow."""
    first = utc(where.since).date().isoformat() if where is not None and where.since is not None else ""
    newest_day = _newest_day(where) if where is not None else None
    last = newest_day.isoformat() if newest_day is not None else "9999-12-31"
    return [d for d in days if first <= d <= last]


def _newest_day(where: LogFilter) -> date | None:
    ends = [last_day_before(where.until)] if where.until is not None else []
    if where.cursor is not None:
        ends.append(utc(where.cursor.timestamp).date())
    return min(ends, default=None)
