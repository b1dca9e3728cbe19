"""Questions from blocks of documents to all documents, and the answers back.

Documents are dealt into blocks of about two megabytes by a hash of doc_id (of the text, without one: such rows come after all
others and remove nothing from each other, so they need no common block). A block asks about its distinct keys (hashes of
windows, grams or words), packed by bucket, that is by range of the hash: one row per block and bucket. The task of a
bucket sees what all blocks ask about its keys and answers each row; the answers go back to the block, which still has its
texts through the same exchange. A key that very many documents share arrives once per block, so hot keys
stay small. Order never matters: keys are sorted and distinct on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20
NO_DOC = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

ASK = "block int, bucket int, payload binary"
_ASK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])


class Layout(NamedTuple):
    blocks: int
    buckets: int


def layout(docs: DataFrame, text: str, keys_per_byte: float) -> Layout:
    """Blocks and buckets for the size of the texts: both grow with the input, so that a group stays as large."""
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Layout(
        max(least, int(size) // BLOCK_BYTES + 1), max(least, int(int(size) * keys_per_byte) // BUCKET_KEYS + 1)
    )


def in_blocks(docs: DataFrame, doc_id: str, text: str, shape: Layout) -> DataFrame:
    """Columns block, doc_id and text; rows of one doc_id share a block, those without one are dealt by their text."""
    key = F.col(doc_id).cast("long")
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(
        block_of(key, F.unhex(digest), shape).alias("block"),
        key.alias("doc_id"),
        F.col(text).cast("string").alias("text"),
    )


def block_of(doc_id: Column, digest: Column, shape: Layout) -> Column:
    """The block of a row, by its doc_id or else by the MD5 digest of its text."""
    key = F.when(doc_id.isNull(), F.xxhash64(digest)).otherwise(F.xxhash64(doc_id))
    return F.pmod(key, F.lit(shape.blocks)).cast("int")


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a block in one order whatever way they arrived: by doc_id, nulls last, then text."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def doc_ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(NO_DOC).to_numpy(zero_copy_only=False).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of the 64-bit hash that a key falls into."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted keys, one for each bucket that has any."""
    owner = bucket_of(keys, buckets)
    cuts = np.flatnonzero(np.diff(owner, prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(keys)]):
        yield int(owner[low]), slice(int(low), int(high))


def packed(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table(
        [
            pa.array([block] * len(rows), pa.int32()),
            pa.array([b for b, _ in rows], pa.int32()),
            pa.array([p for _, p in rows], pa.binary()),
        ],
        schema=_ASK,
    )


def answered(asks: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Answer the rows of each bucket together; payloads come in the order of their blocks."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        replies = answer([p.as_buffer() for p in table["payload"].combine_chunks()])
        return pa.table([table["block"], table["bucket"], pa.array(replies, pa.binary())], schema=_ASK)

    return asks.groupBy("bucket").applyInArrow(bucket, ASK)


def replies(table: pa.Table) -> list:
    """The answers to a block, in the order of its buckets."""
    return [p.as_buffer() for p in table.sort_by("bucket")["payload"].combine_chunks()] if len(table) else []


# Which keys do at least two documents hold? A key is a 64-bit hash; its bucket and low 32 bits stand for it, so a rare
# chance hit names a key that is not shared. Callers verify what they do with a hit.


def shared_asks(keys: np.ndarray, twice: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """keys: sorted, distinct; twice: those that two documents of the block hold."""
    low = keys.astype(np.uint32)
    return [(b, low[s].tobytes() + np.packbits(twice[s]).tobytes()) for b, s in by_bucket(keys, buckets)]


def _keys_in(size: int) -> int:
    """Number of keys in a payload of 4 bytes and one bit each."""
    count = size * 8 // 33
    while 4 * count + (count + 7) // 8 < size:
        count += 1
    return count


def shared_answer(payloads: list) -> list[bytes]:
    """One bit per key."""
    counts = [_keys_in(len(p)) for p in payloads]
    keys = [np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, counts)]
    twice = [
        np.unpackbits(np.frombuffer(p, np.uint8, offset=4 * n), count=n).astype(bool) for p, n in zip(payloads, counts)
    ]
    every = np.sort(np.concatenate(keys))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(k[t] for k, t in zip(keys, twice))]))
    return [np.packbits(member(k, shared)).tobytes() for k in keys]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def shared_bits(keys: np.ndarray, buckets: int, answers: list) -> np.ndarray:
    """The answers to the keys of ``shared_asks``, one boolean each."""
    parts = [
        np.unpackbits(np.frombuffer(a, np.uint8), count=s.stop - s.start)
        for (_, s), a in zip(by_bucket(keys, buckets), answers, strict=True)
    ]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, whether two documents hold each, and the place of each given key among them."""
    order = np.argsort(keys, kind="stable")
    ordered, owners = keys[order], docs[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    heads = np.flatnonzero(new)
    differs = np.zeros(len(keys), dtype=bool)
    differs[1:] = ~new[1:] & (owners[1:] != owners[:-1])
    twice = np.logical_or.reduceat(differs, heads) if len(heads) else np.zeros(0, dtype=bool)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[heads], twice, place
