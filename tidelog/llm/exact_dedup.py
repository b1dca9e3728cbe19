"""Exact dedup through an index of digests: cuckoo filters in front of the stored keys.

The index is dealt into buckets by digest. A bucket holds its live digests and a cuckoo filter over them: 16-bit fingerprints in
two possible places of four slots. A digest that the filter does not know is new without a look at the stored keys; a hit is
verified against the keys of the bucket. Digests can be deleted again. When an insertion finds no place, or the filter
is nearly full, it is rebuilt at twice the size from the stored keys.

``duplicates`` runs whole tables through such indexes: tasks first merge the rows of their batches, so that a text with very
many copies reaches its bucket once per batch, then every bucket inserts what arrives and merges verified hits.
``update`` and ``lookup`` keep an index from one load to the next.

Defined results: null text counts as empty. Texts are compared by their bytes, so those that are not UTF-8 are as good as others.
Of equal texts the row with the most code points stays, then the one with
the smallest doc_id; a null doc_id comes last. Rows that agree in doc_id, text length and normalised text are one document:
``duplicates`` marks all of them alike, ``deduplicate`` returns one. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import blocks, words
from tidelog.session import shared_dir

MEMBERS = ["digest", "members", "n_points", "doc_id", "twins"]
PARTIAL = "bucket int, digest binary, members long, n_points long, doc_id long, twins long"
CLASSES = "digest binary, keep_id long, keep_points long, group_size long, twins long"
BUCKET_ROWS = 250_000
MOST_BROADCAST = 250_000  # classes of some 100 bytes

Members = tuple[int, int, int, int]  # members, n_points and doc_id of the row that stays, rows equal to it
INDEX = "bucket int, filter binary, digests binary"
SLOTS = 4
MOST_KICKS = 200


class CuckooFilter:
    """Fingerprints of 32-byte digests, given as arrays of four 64-bit numbers."""

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        size = 1 << max(3, int(capacity / (0.85 * SLOTS)).bit_length())
        self.table = np.zeros((size, SLOTS), dtype=np.uint16) if table is None else table
        self.random = np.random.default_rng(len(self.table))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1  # 0 is an empty slot
        return prints, (digests[:, 2] % np.uint64(len(self.table))).astype(np.int64)

    def other(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        step = words.mix(prints.astype(np.uint64), 11) & np.uint64(len(self.table) - 1)
        return place ^ step.astype(np.int64)

    def contains(self, digests: np.ndarray) -> np.ndarray:
        prints, place = self.places(digests)
        hit = (self.table[place] == prints[:, None]).any(axis=1)
        return hit | (self.table[self.other(prints, place)] == prints[:, None]).any(axis=1)

    def settle(self, prints: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Put fingerprints into free slots of their places; which ones found none."""
        order = np.argsort(place, kind="stable")
        ordered = place[order]
        turn = np.arange(len(order)) - np.searchsorted(ordered, ordered)
        free = self.table[ordered] == 0
        fits = turn < free.sum(axis=1)
        slot = np.argmax(free & (np.cumsum(free, axis=1) == turn[:, None] + 1), axis=1)
        self.table[ordered[fits], slot[fits]] = prints[order][fits]
        rest = np.ones(len(order), dtype=bool)
        rest[order[fits]] = False
        return rest

    def insert(self, digests: np.ndarray) -> bool:
        """Insert all; false if some found no place even after moving others, and the filter is to be rebuilt larger."""
        prints, place = self.places(digests)
        rest = self.settle(prints, place)
        prints, place = prints[rest], self.other(prints[rest], place[rest])
        for _ in range(MOST_KICKS):
            rest = self.settle(prints, place)
            prints, place = prints[rest], place[rest]
            if not len(prints):
                return True
            _, first = np.unique(place, return_index=True)  # one eviction per place and round
            slot = self.random.integers(0, SLOTS, len(first))
            victims = self.table[place[first], slot].copy()
            self.table[place[first], slot] = prints[first]
            prints[first] = victims
            place[first] = self.other(victims, place[first])
        return False

    def delete(self, digests: np.ndarray) -> None:
        """Take out one fingerprint of each digest; only for digests that were inserted."""
        prints, place = self.places(digests)
        for one, here, there in zip(prints, place, self.other(prints, place)):
            for at in (here, there):
                slots = np.flatnonzero(self.table[at] == one)
                if len(slots):
                    self.table[at, slots[0]] = 0
                    break


class DigestIndex:
    """The live digests of a bucket, numbered in the order of insertion, behind a cuckoo filter."""

    def __init__(self, keys: dict[bytes, int] | None = None, table: np.ndarray | None = None):
        self.keys = keys or {}
        self.issued = len(self.keys)
        self.filter = CuckooFilter(max(64, len(self.keys)), table)

    def find(self, digests: list[bytes]) -> list[int | None]:
        """The number of each digest, or None; only hits of the filter are looked up among the keys."""
        hits = self.filter.contains(as_numbers(digests)) if digests else []
        return [self.keys.get(d) if hit else None for d, hit in zip(digests, hits)]

    def insert(self, digests: list[bytes]) -> None:
        """Add distinct digests that are not in the index."""
        for d in digests:
            self.keys[d] = self.issued
            self.issued += 1
        full = len(self.keys) > 0.9 * self.filter.table.size
        if digests and (full or not self.filter.insert(as_numbers(digests))):
            self.resize()

    def resize(self) -> None:
        capacity = max(len(self.keys), self.filter.table.size)
        while True:
            self.filter = CuckooFilter(capacity)
            if self.filter.insert(as_numbers(list(self.keys))):
                return
            capacity *= 2

    def delete(self, digests: list[bytes]) -> None:
        """Remove digests; those that are not live are passed over."""
        live = [d for d, number in zip(digests, self.find(digests)) if number is not None]
        live = list(dict.fromkeys(live))
        if live:
            self.filter.delete(as_numbers(live))
        for d in live:
            del self.keys[d]


def as_numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def text_digest(text: str) -> Column:
    """SHA-256 of the bytes of a text without whitespace, the same wherever it is computed.

    The bytes are read as Latin-1, one character each, so a text that is not UTF-8 keeps them all.
    """
    characters = F.decode(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), "ISO-8859-1")
    return F.unhex(F.sha2(F.encode(F.regexp_replace(characters, "[\\x20\\x09-\\x0D]+", ""), "ISO-8859-1"), 256))


def code_points(text: str) -> Column:
    return F.char_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, SHA-256 of the text without its whitespace, code points of the text."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"), code_points(text).alias("n_points")
    )


def better(points: int, doc_id: int, than: Members) -> bool:
    return (-points, doc_id) < (-than[1], than[2])


def merge(found: dict[bytes, Members], rows) -> None:
    """Merge (digest, members, points, doc_id, twins) into members, best row and number of rows equal to it, per digest."""
    for digest, members, points, doc_id, twins in rows:
        known = found.get(digest)
        if known is None or better(points, doc_id, known):
            found[digest] = (members + (known[0] if known else 0), points, doc_id, twins)
        else:
            again = twins if (points, doc_id) == known[1:3] else 0
            found[digest] = (known[0] + members, *known[1:3], known[3] + again)


def duplicates(keyed: DataFrame, digest_buckets: int | None = None) -> DataFrame:
    """Per distinct digest: the row that stays, its code points, the number of rows, and of rows with its id and code points.

    The buckets grow with the rows, so that the index of one stays as large.
    """
    least = 4 * int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = digest_buckets or max(least, keyed.count() // BUCKET_ROWS + 1)

    def within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(blocks.NO_DOC).to_pylist()
            own: dict[bytes, Members] = {}
            rows = zip(batch.column("digest").to_pylist(), batch.column("n_points").to_pylist(), ids)
            merge(own, ((d, 1, points, i, 1) for d, points, i in rows))
            if own:
                columns = [pa.array(column, pa.int64()) for column in zip(*own.values())]
                buckets = pa.array([int.from_bytes(d[:4], "big") % count for d in own], pa.int32())
                yield pa.RecordBatch.from_arrays([buckets, pa.array(list(own), pa.binary()), *columns], ["bucket", *MEMBERS])

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, best = DigestIndex(), []
        for batch in batches:
            arrived: dict[bytes, Members] = {}
            merge(arrived, zip(*(batch.column(c).to_pylist() for c in MEMBERS)))
            numbers = index.find(list(arrived))
            new = [d for d, n in zip(arrived, numbers) if n is None]
            index.insert(new)
            best.extend(arrived[d] for d in new)
            for (digest, row), n in zip(arrived.items(), numbers):
                if n is not None:
                    both = {digest: best[n]}
                    merge(both, [(digest, *row)])
                    best[n] = both[digest]
        members, points, keep, twins = (np.array([b[k] for b in best], dtype=np.int64) for k in range(4))
        kept = pa.array(keep, mask=keep == blocks.NO_DOC)
        columns = [pa.array(list(index.keys), pa.binary()), kept, *map(pa.array, (points, members, twins))]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "keep_id", "keep_points", "group_size", "twins"])

    return keyed.mapInArrow(within_batches, PARTIAL).groupBy("bucket").applyInArrow(in_bucket, CLASSES)


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, digest, keep_id, group_size, kept."""
    keyed = digests(docs, doc_id, text)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    return keyed.join(duplicates(keyed), "digest").select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows that stay, with the columns of the documents.

    Only classes of several rows are joined to the documents, which therefore stay where they are as long as the classes can be
    broadcast; beyond ``most_broadcast`` of them both sides are exchanged by digest. Rows that agree with the winner in all that
    decides are reduced to one by an aggregation that combines before its exchange.
    """
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    classes = duplicates(digests(docs, doc_id, text)).where("group_size > 1").withColumnRenamed("digest", "class")
    classes = classes.checkpoint()
    several = classes.agg(F.count(F.lit(1)).alias("n"), F.max("twins").alias("twins")).first()
    named = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.col(doc_id).cast("long").alias("id"),
        text_digest(text).alias("digest"),
        code_points(text).alias("n_points"),
    )
    side = F.broadcast(classes) if several["n"] <= most_broadcast else classes
    joined = named.join(side, F.col("digest") == F.col("class"), "left")
    wins = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
    alone = joined.where(F.col("class").isNull() | (wins & (F.col("twins") == 1))).select("row.*")
    if (several["twins"] or 1) == 1:
        return alone
    equal = joined.where(wins & (F.col("twins") > 1)).groupBy("digest")
    return alone.unionByName(equal.agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*"))


# An index that lasts: a DataFrame of buckets, to be written wherever the caller keeps it.


def load(bucket: pa.Table) -> DigestIndex:
    if not len(bucket):
        return DigestIndex()
    raw = bucket["digests"][0].as_py()
    table = np.frombuffer(bucket["filter"][0].as_py(), np.uint16).reshape(-1, SLOTS).copy()
    return DigestIndex({raw[i : i + 32]: i // 32 for i in range(0, len(raw), 32)}, table)


def update(index: DataFrame, changes: DataFrame, buckets: int) -> DataFrame:
    """The index after changes (digest binary, live boolean): true inserts, false deletes, deletions last."""

    def change(key: tuple, stored: pa.Table, wanted: pa.Table) -> pa.Table:
        bucket = load(stored)
        live = wanted["live"].to_pylist() if len(wanted) else []
        given = wanted["digest"].to_pylist() if len(wanted) else []
        added = list(dict.fromkeys(d for d, on in zip(given, live) if on))
        bucket.insert([d for d, n in zip(added, bucket.find(added)) if n is None])
        bucket.delete([d for d, on in zip(given, live) if not on])
        table, kept = bucket.filter.table.tobytes(), b"".join(bucket.keys)
        return pa.table(
            {
                "bucket": pa.array([key[0].as_py()], pa.int32()),
                "filter": pa.array([table], pa.binary()),
                "digests": pa.array([kept], pa.binary()),
            }
        )

    dealt = changes.where("digest is not null and live is not null").withColumn("bucket", bucket_of("digest", buckets))
    return index.groupBy("bucket").cogroup(dealt.distinct().groupBy("bucket")).applyInArrow(change, INDEX)


def lookup(index: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """Per distinct digest wanted: is it live in the index?"""

    def look(stored: pa.Table, wanted: pa.Table) -> pa.Table:
        given = wanted["digest"].to_pylist() if len(wanted) else []
        found = load(stored).find(given)
        return pa.table(
            {"digest": pa.array(given, pa.binary()), "live": pa.array([n is not None for n in found], pa.bool_())}
        )

    dealt = wanted.select("digest").where("digest is not null").distinct().withColumn("bucket", bucket_of("digest", buckets))
    return index.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(look, "digest binary, live boolean")


def bucket_of(digest: str, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
