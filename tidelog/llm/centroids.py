"""Centroid clustering (Lloyd's rounds on integer vectors) over zone maps along a space-filling curve.

Vectors are put in the order of a Hilbert curve through their ``DIMS`` widest dimensions and packed into blocks of neighbours. A block
keeps the box of its vectors: the least and greatest value of every dimension. In each round the distances of a
centroid to the box bound its distances to all vectors of the block: centroids whose lower bound exceeds the least upper bound
cannot be nearest to any of them. The others are compared exactly, one block at a time in numpy. Blocks are made once;
a round sends per task one sum for each centroid and component, and the driver gets their totals (k * (size + 2) numbers).

Components are integers floor(scale * x), so all sums and distances are exact and reruns agree to the last digit. Vectors of blocks with
small components are compared by a matrix product in doubles, which is exact below 2^53, the others in 64-bit integers.

The blocks are dealt by ranges of the curve with a row number behind it, so a vector that a third of the rows hold spreads over tasks.
k and rounds are parameters; k centroids travel with the task.

Defined results: only vectors with exactly ``size`` finite components are kept; null, short, long and other vectors give no row. Equal
distances go to the smaller number. Integers beyond ±2^27 are set to ±2^27, so that a distance fits 64 bits; sums
do for 2^36 vectors. A null vec_id is hashed as the text ``null``; rows that share a vec_id are told apart by their components
when the first centroids are chosen, and all returned. With fewer than k vectors there are as many centroids as vectors; an
empty table gives no rows. An empty cluster keeps its centroid. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import shared_dir

SIZE = 64
LIMIT = 1 << 27
BLOCK = 256  # vectors
DIMS, BITS = 15, 4  # dimensions of the curve, and bits of a cell in each

KEYED = "vec_id long, curve long, vector binary"
BLOCKS = "ids array<long>, vectors binary, low binary, high binary"
SUMS = "cluster int, slot int, total long"
ASSIGNED = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell numbers below 2^bits; at most 63 bits in all.

    From the highest bit down, a set bit mirrors the lower bits of the first axis and a clear one swaps them with the
    first axis; the Gray code of what results, read across the axes, is the place.
    """
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(len(axes)):
            mirrored = (axes[i] >> bit) & 1 == 1
            moved = np.where(mirrored, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = axes[0] ^ np.where(mirrored, below, moved)
            axes[i] = axes[i] ^ moved if i else axes[i]
    place = np.zeros(len(cells), dtype=np.int64)
    last = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):  # undo the Gray code while reading its bits
        for axis in axes:
            last = ((axis >> bit) & 1) ^ last
            place = place << 1 | last
    return place


def integers(vectors: DataFrame, vec_id: str, vector: str, size: int, scale: int) -> DataFrame:
    """vec_id and the kept vectors: each component floor(scale * x), as little-endian 32-bit integers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == size) & finite)
    source = kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(given * scale), -LIMIT, LIMIT).astype("<i4").reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([row.tobytes() for row in whole], pa.binary())], ["vec_id", "vector"]
            )

    return source.mapInArrow(convert, "vec_id long, vector binary")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def totals(rows: DataFrame, key: list[str]) -> list:
    """Sums over all tasks: as many rows as there are keys."""
    return rows.groupBy(*key).agg(F.sum("total").alias("total")).collect()


class Grid(NamedTuple):
    """The dimensions of the curve, and the bounds between their cells."""

    dims: list[int]
    origin: np.ndarray
    step: np.ndarray

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        cells = np.floor((vectors[:, self.dims] - self.origin) / self.step)
        return np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64)


def grid(kept: DataFrame, size: int) -> Grid | None:
    """Cells of a quarter of a standard deviation around the mean of the dimensions that vary most."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size))
        for batch in batches:
            v = matrix(batch.column("vector"), size).astype(float)
            sums += np.stack([np.full(size, len(v)), v.sum(axis=0), (v * v).sum(axis=0)])
        if sums[0, 0]:
            yield pa.RecordBatch.from_arrays(
                [np.repeat(np.arange(3), size), np.tile(np.arange(size), 3), sums.ravel()], ["what", "dim", "total"]
            )

    sums = np.zeros((3, size))
    for row in totals(kept.mapInArrow(moments, "what long, dim long, total double"), ["what", "dim"]):
        sums[row["what"], row["dim"]] = row["total"]
    if not sums[0, 0]:
        return None
    mean = sums[1] / sums[0]
    spread = np.maximum(sums[2] / sums[0] - mean * mean, 0)
    dims = sorted(np.argsort(-spread, kind="stable")[:DIMS].tolist())
    step = np.maximum(4 * np.sqrt(spread[dims]) / (1 << BITS), 1e-9)
    return Grid(dims, mean[dims] - step * (1 << (BITS - 1)), step)


def zone_map(kept: DataFrame, cells: Grid, size: int, block: int) -> DataFrame:
    """Blocks of neighbours on the curve with their boxes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            curve = hilbert(cells.cells(matrix(batch.column("vector"), size)), BITS)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(curve), batch.column("vector")], ["vec_id", "curve", "vector"])

    def packed(ids: list, vectors: list) -> pa.RecordBatch:
        v = np.frombuffer(b"".join(vectors), "<i4").reshape(-1, size)
        values = [[ids], *([x.astype("<i4").tobytes()] for x in (v, v.min(axis=0), v.max(axis=0)))]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], ["ids", "vectors", "low", "high"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        vectors: list = []
        for batch in batches:
            ids += batch.column("vec_id").to_pylist()
            vectors += batch.column("vector").to_pylist()
            whole = len(ids) - len(ids) % block
            for i in range(0, whole, block):
                yield packed(ids[i : i + block], vectors[i : i + block])
            ids, vectors = ids[whole:], vectors[whole:]
        if ids:
            yield packed(ids, vectors)

    ranged = (
        kept.mapInArrow(keyed, KEYED)
        .withColumn("salt", F.monotonically_increasing_id())
        .repartitionByRange("curve", "salt")
        .sortWithinPartitions("curve", "salt")
    )
    return ranged.select("vec_id", "vector").mapInArrow(pack, BLOCKS).checkpoint()


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids that can be nearest to a point of the box."""
    gap = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (far * far).sum(axis=1).min())


def nearest(vectors: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per vector the nearest centroid, the smaller number of equal ones, and its squared distance."""
    some = candidates(low, high, centroids)
    near = centroids[some]
    widest = max(int(np.abs(near).max()), int(np.abs(low).max()), int(np.abs(high).max()))
    if 4 * vectors.shape[1] * widest * widest < 1 << 53:
        v, c = vectors.astype(float), near.astype(float)
        away = ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        away = np.stack([((vectors - c) ** 2).sum(axis=1) for c in near], axis=1)
    best = away.argmin(axis=1)
    return some[best], away[np.arange(len(best)), best]


def in_blocks(size: int, centroids: np.ndarray) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for row in batch.to_pylist():
                v, low, high = (np.frombuffer(row[c], "<i4").reshape(-1, size).astype(np.int64) for c in ("vectors", "low", "high"))
                yield row["ids"], v, *nearest(v, low[0], high[0], centroids)

    return read


def measured(blocks: DataFrame, centroids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per centroid the componentwise sums of its vectors, their number, and their summed distances."""
    k, read = len(centroids), in_blocks(size, centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k, size + 2), dtype=np.int64)
        for _, v, cluster, distance in read(batches):
            np.add.at(own, cluster, np.column_stack([v, np.ones(len(v), np.int64), distance]))
        some = np.flatnonzero(own[:, size])
        if len(some):
            slots = np.tile(np.arange(size + 2, dtype=np.int32), len(some))
            yield pa.RecordBatch.from_arrays(
                [np.repeat(some.astype(np.int32), size + 2), slots, own[some].ravel()], ["cluster", "slot", "total"]
            )

    out = np.zeros((k, size + 2), dtype=np.int64)
    for row in totals(blocks.mapInArrow(sums, SUMS), ["cluster", "slot"]):
        out[row["cluster"], row["slot"]] = row["total"]
    return out[:, :size], out[:, size], out[:, size + 1]


def first_centroids(kept: DataFrame, k: int, size: int, seed: int) -> np.ndarray:
    """The k vectors whose vec_ids have the least digests."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = kept.withColumn("digest", F.sha2(name, 256)).orderBy("digest", "vec_id", "vector").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in rows], dtype=np.int64).reshape(-1, size)


def cluster(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    size: int = SIZE,
    scale: int = 256,
    seed: int = 2,
    block: int = BLOCK,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    shared_dir(spark)  # names the checkpoint folder of a local session
    kept = integers(vectors, vec_id, vector, size, scale)
    cells = grid(kept, size)
    if cells is None:
        return spark.createDataFrame([], ASSIGNED)
    centroids = first_centroids(kept, k, size, seed)
    blocks = zone_map(kept, cells, size, block)
    for _ in range(rounds):
        sums, members, _ = measured(blocks, centroids, size)
        some = members > 0
        centroids[some] = sums[some] // members[some, None]
    _, _, inertia = measured(blocks, centroids, size)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    everything, read = int(inertia.sum()), in_blocks(size, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, number, distance in read(batches):
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(number, pa.int32()),
                pa.array(distance, pa.int64()),
                pa.array(inertia[number], pa.int64()),
                pa.array(np.full(len(ids), everything), pa.int64()),
                pa.array([digests[n] for n in number], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ASSIGNED.split(", ")])

    return blocks.mapInArrow(assign, ASSIGNED)
