"""Words and rolling hashes of whole texts, in numpy over Arrow buffers.

Texts of a batch stay in one byte buffer with offsets. Words are maximal runs of bytes outside a separator set; a word
never crosses from one text into the next. Hashes are 64-bit polynomials over byte (or word) values, so that the hash
of any run follows from two prefix sums; they are mixed afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = 1 << 20  # bytes hashed at a time
CHUNK = 2 << 20  # bytes of text handled at a time
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values (the finishing steps of splitmix64)."""
    x = values ^ np.uint64((salt * 0xD1342543DE82EF95) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up = np.full(size, BASE, dtype=np.uint64)
    up[:1] = 1
    down = np.full(size, BASE_INVERSE, dtype=np.uint64)
    down[:1] = 1
    return np.cumprod(up), np.cumprod(down)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64), 1)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hash of each run values[start:end]; equal runs hash equal wherever they lie."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Unmixed hash of every run of ``size`` neighbours."""
    if len(values) < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    grams = sums[size:] - sums[:-size]
    grams *= down[: len(grams)]
    return grams


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends at most ``BATCH_ROWS`` of them to Python at a time.

    Spark's default of 10,000 would hold tens of megabytes of text in the task and in its Python worker.
    """
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return docs


def ids_and_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Columns doc_id and text, in small batches."""
    named = (F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_small_batches(docs).select(*named)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # nothing to combine
            column = pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buffer, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text stands alone."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(count, max(first + 1, last))
        yield first, last
        first = last


class Words(NamedTuple):
    buffer: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in the buffer
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray  # mixed 64-bit hash of each word
    first: np.ndarray  # first word of each text, and the number of words at the end

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words_of(buffer: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    inside = ~(separators[LOWER] if lower else separators)[buffer]
    edge = np.zeros(len(buffer) + 1, dtype=bool)
    edge[offsets] = True
    before = np.ones(len(buffer), dtype=bool)
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.ones(len(buffer), dtype=bool)
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):  # words of about one segment at a time, so that memory follows the words
        low = starts[done]
        until = max(done + 1, int(np.searchsorted(ends, low + SEGMENT, side="right")))
        piece = buffer[low : ends[until - 1]]
        values = BYTE_VALUES[LOWER[piece]] if lower else BYTE_VALUES[piece]
        hashes[done:until] = run_hashes(values, starts[done:until] - low, ends[done:until] - low)
        done = until
    return Words(buffer, offsets, starts, ends, mix(hashes), np.searchsorted(starts, offsets))


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` neighbours."""
    if len(values) < size:
        return values[:0]
    reach, out = 1, values
    while reach * 2 <= size:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    if reach < size:
        rest = size - reach
        out = np.minimum(out[:-rest], out[rest:])
    return out


def joined_words(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space, as Arrow binary."""
    texts = words.texts()[kept]
    starts, ends = words.starts[kept], words.ends[kept]
    steps = np.zeros(len(words.buffer) + 1, dtype=np.int8)
    steps[starts] += 1
    steps[ends] -= 1
    mask = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    again = np.ones(len(texts), dtype=bool)
    again[:1] = False
    again[1:] = texts[1:] == texts[:-1]
    gaps = starts[again] - 1  # the separator before a word that is not the first kept one of its text
    out = words.buffer.copy()
    out[gaps] = 0x20
    mask[gaps] = True
    return cut(out, words.offsets, mask)


def cut(buffer: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> pa.Array:
    """The masked bytes of each text as Arrow binary."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return binary_array(buffer[mask], sums[offsets])


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if len(data) >= 1 << 31:
        raise ValueError("one batch of results holds over 2 GiB of text")
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets.astype(np.int32))), pa.py_buffer(np.ascontiguousarray(data))],
    )


def sha256_of(column: pa.Array) -> list[bytes]:
    """SHA-256 digest of each binary value."""
    return [hashlib.sha256(value.as_buffer()).digest() for value in column]


def runs_of(mask: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of true values; a run also ends at each edge."""
    cuts = np.zeros(len(mask) + 1, dtype=bool)
    cuts[edges] = True
    before = np.zeros(len(mask), dtype=bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(mask), dtype=bool)
    after[:-1] = mask[1:]
    return np.flatnonzero(mask & (~before | cuts[:-1])), np.flatnonzero(mask & (~after | cuts[1:])) + 1


def spread(starts: np.ndarray, length: int | np.ndarray, size: int) -> np.ndarray:
    """Mark [start, start + length) for every start in a mask of ``size``."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + length, size), -1)
    return np.cumsum(steps[:-1]) > 0
