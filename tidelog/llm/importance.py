"""Importance resampling towards a target distribution, on hashed n-grams of raw UTF-8.

A 256-byte table lower-cases A-Z and turns separators into blanks; ``bytes.split`` yields the words. The CRC-32 of a word
is the seed of the next one with a blank before it, so each further word extends an n-gram by one step. Buckets
are counted by Counters, one per task, and only these (at most ``buckets`` numbers per task) are shuffled and summed. The gain of
a bucket, a scaled log ratio of its smoothed shares in the target and in the corpus, goes back to the tasks
as a list of ``buckets`` integers. A document weighs the sum of its gains; with Gumbel noise from a digest of its id, the highest scores
are a sample without replacement with chances in proportion to the exponentials of the weights.

Scores are ranked across range partitions, with no task that holds all drawn rows: one exchange of a few numbers per document. Texts
are read in pieces of about ``PIECE`` bytes; an n-gram over a cut is found from the seeds of the piece before.

Defined results: null text is empty, has no features and weight 0, and is never drawn, like all texts below ``least_words``
words. Bytes that are not UTF-8 are bytes of words. A null doc_id is hashed as the text ``null`` and comes after all others among equal scores;
rows of one doc_id and score are ordered by weight and number of features, and are all returned. Empty tables are allowed on both sides:
without target or corpus the smoothing alone is left. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words
from tidelog.operators.positions import with_positions
from tidelog.session import shared_dir

TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if words.NOT_ALNUM[b] else b for b in range(256))
GRAMS = 3
BUCKETS = 10_000
PIECE = 1 << 18


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in pieces of about ``PIECE`` bytes."""
    plain, start = data.translate(TABLE), 0
    while start < len(plain):
        end = plain.find(b" ", start + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def features(data: bytes, grams: int = GRAMS) -> Iterator[tuple[int, list[int]]]:
    """CRC-32 of all runs of 1 to ``grams`` words, each list with the number of words that it begins with.

    ``before[n]`` is the hash of the n + 1 words up to the end of the last piece; it is missing where the text has fewer.
    """
    before: list[list[int]] = [[] for _ in range(grams - 1)]
    for piece in pieces(data):
        if not piece:
            continue
        spaced = [b" " + w for w in piece]
        hashes = [list(map(crc32, piece))]
        for n in range(grams - 1):
            shorter = before[n] + hashes[n][:-1]  # one run for each word that has enough words before it
            hashes.append(list(map(crc32, spaced[len(spaced) - len(shorter) :], shorter)))
        before = [h[-1:] or before[n] for n, h in enumerate(hashes[: grams - 1])]
        yield len(piece), [h for run in hashes for h in run]


def texts(frame: DataFrame, *columns: str | Column) -> DataFrame:
    return words.in_small_batches(frame).select(*columns)


def counted(frame: DataFrame, text: str, buckets: int) -> dict[int, int]:
    """Features of all texts by bucket: at most ``buckets`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[int] = Counter()
        for batch in batches:
            for value in batch.column(0):
                for _, found in features(value.as_py() or b""):
                    own.update([h % buckets for h in found])
        if own:
            yield pa.RecordBatch.from_arrays(
                [pa.array(own.keys(), pa.int32()), pa.array(own.values(), pa.int64())], ["bucket", "n"]
            )

    found = texts(frame, F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Per bucket floor(1000 * ln) of the ratio of its smoothed shares in the target and in the corpus."""
    whole, wanted = sum(corpus.values()), sum(target.values())
    return [
        math.floor(
            1000 * math.log(float((target.get(b, 0) + 1) * (whole + buckets)) / float((corpus.get(b, 0) + 1) * (wanted + buckets)))
        )
        for b in range(buckets)
    ]


def weighed(docs: DataFrame, gain: list[int], doc_id: str, text: str) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                n_words = n_features = weight = 0
                for n, found in features(value.as_py() or b""):
                    n_words += n
                    n_features += len(found)
                    weight += sum([gain[h % buckets] for h in found])
                out.append((n_words, n_features, weight))
            columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"])

    source = texts(docs, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return source.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> Column:
    """floor(1000 * g) for a Gumbel number g from 32 bits of a digest of the seed and the doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = 5,
    least_words: int = 20,
    buckets: int = BUCKETS,
    seed: int = 42,
) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score, rank (null if it is not drawn)."""
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    gain = gains(counted(docs, text, buckets), counted(target, target_text, buckets), buckets)
    rows = (
        weighed(docs, gain, doc_id, text)
        .withColumn("score", F.col("weight") + gumbel("doc_id", seed))
        .withColumn("short", F.col("n_words") < least_words)
        .withColumn("unnamed", F.col("doc_id").isNull())
        .withColumn("salt", F.monotonically_increasing_id())
        .checkpoint()  # texts are not weighed again when ranges are sampled
    )
    drawn = rows.where(~F.col("short")).count() * percent // 100
    order = ["short", ("score", False), "unnamed", "doc_id", "weight", "n_features", "salt"]
    placed = with_positions(rows, *order)
    rank = F.when(~F.col("short") & (F.col("position") < drawn), F.col("position") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
