"""Parts of the id space for streams that write at the same time.

An id has the number of a part in its high bits. A part belongs to one stream for good, so two streams never give out
the same id, whatever they know of each other's batches; within a part a stream counts on from its own last commit.

A part is claimed by a file that names its stream, and owned once a listing after that shows no other claim to it.
Of two streams that claim at the same moment at least one sees the other and goes on to a further part, so
this needs no locks and no atomic creation, only that a written file is listed. A part that nobody came to own is skipped.
"""

from __future__ import annotations

import random
import time

from pyspark.sql import SparkSession

from tidelog.sources import paths

PART_BITS = 53
# A batch starts in the first half of a part, and none spans more than half of one.
MOST_USED = 1 << (PART_BITS - 1)
MOST_PARTS = 1 << (63 - PART_BITS)


def _owned(names: list[str], stream: str) -> list[int]:
    return [int(n.split(".")[0]) for n in names if n.split(".")[1:] == [stream, "own"]]


def _claim(spark: SparkSession, folder: str, stream: str) -> int:
    attempt = 0
    while True:
        taken = [int(n.split(".")[0]) for n in paths.names(spark, folder) if n[0] not in "._"]
        part = max(taken, default=0) + 1  # part 0 is left to ids from elsewhere
        if part >= MOST_PARTS:
            raise ValueError("the table has no ids left")
        mine = f"{part}.{stream}.claim"
        paths.write_text(spark, f"{folder}/{mine}", stream)
        if [n for n in paths.names(spark, folder) if n.startswith(f"{part}.")] == [mine]:
            paths.write_text(spark, f"{folder}/{part}.{stream}.own", stream)
            return part
        attempt += 1
        time.sleep(random.uniform(0, 0.05 * min(attempt, 40)))


def next_base(spark: SparkSession, folder: str, stream: str, limit: int) -> int:
    """Where the ids of the next batch of a stream begin; ``limit`` is the end of its committed ids."""
    part, used = limit >> PART_BITS, limit & ((1 << PART_BITS) - 1)
    owned = _owned(paths.names(spark, folder), stream)
    if part in owned and used <= MOST_USED:
        return limit
    unused = [p for p in owned if p > part]  # claimed for a batch that was never committed
    return (min(unused) if unused else _claim(spark, folder, stream)) << PART_BITS
