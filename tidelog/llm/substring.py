"""Substring dedup: word windows that an earlier document also holds, found through difference-cover anchors.

A difference cover D of a period p holds, for every distance d, two members that differ by d modulo p. Only grams that
start at word positions in D (modulo p) are hashed. If the same ``window`` words start at position a of one document and b
of another, some shift below p puts both positions into D, so the two documents share an anchor of
``window - p + 1`` words at the same place of the match. Documents exchange anchors first (three sevenths of all positions);
then each anchor that two documents hold is extended to the windows around it, and only those are
compared in full, as 96-bit hashes with the smallest doc_id that holds them.

Defined results: null and empty texts have no words and lose nothing. Rows with one doc_id count as one document: they do
not remove from each other, and each row gets its own result. A null doc_id comes after all others: such rows lose
what any other document holds and take nothing away. Other columns are not read. Texts shorter than the window are kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import blocks, words

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept_text binary"


def covers(cover: tuple[int, ...], period: int) -> bool:
    """Does every distance modulo the period occur between two members?"""
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = 13,
    period: int = 7,
    cover: tuple[int, ...] = (0, 1, 3),
) -> DataFrame:
    """Per document the words left when each word goes that is covered by a window which starts in an earlier document.

    ``removed`` has the word ranges [start, end), ``kept_text`` the other words joined by one space, in UTF-8.
    """
    if not covers(cover, period) or not 1 <= window - period + 1:
        raise ValueError("the cover must reach every distance of the period, which must not exceed the window")
    shape = blocks.layout(docs, text, 0.08)
    texts = blocks.in_blocks(docs, doc_id, text, shape)
    length = window - period + 1
    residues = np.isin(np.arange(period), cover)

    def read(table: pa.Table) -> tuple[pa.Table, words.Words, np.ndarray, np.ndarray]:
        table = blocks.in_order(table)
        found = words.words_of(*words.text_bytes(table["text"]))
        place = np.arange(len(found.starts)) - np.repeat(found.first[:-1], found.counts())
        whole = place + window <= np.repeat(found.counts(), found.counts())  # a window starts here
        return table, found, place, whole

    def anchors(found: words.Words, place: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
        counts = np.repeat(found.counts(), found.counts())
        at = np.flatnonzero(residues[place % period] & (place + length <= counts) & (counts >= window))
        keys = words.mix(words.gram_hashes(found.hashes, length)[at], 2)
        return at, *blocks.distinct(keys, owners[at])

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        table, found, place, _ = read(table)
        owners = blocks.doc_ids(table)[found.texts()]
        _, keys, twice, _ = anchors(found, place, owners)
        return blocks.packed(key[0].as_py(), blocks.shared_asks(keys, twice, shape.buckets))

    def candidates(table: pa.Table, replies: list) -> tuple:
        """The windows around shared anchors: place in the list of distinct ones, and smallest owner of each."""
        table, found, place, whole = read(table)
        owners = blocks.doc_ids(table)[found.texts()]
        at, keys, _, where = anchors(found, place, owners)
        shared = at[blocks.shared_bits(keys, shape.buckets, replies)[where]]
        starts = np.flatnonzero(words.spread(np.maximum(shared - period + 1, 0), period, len(place)) & whole)
        high = words.mix(words.gram_hashes(found.hashes, window)[starts], 3)
        low = words.mix(words.gram_hashes(words.mix(found.hashes, 4), window)[starts], 5).astype(np.uint32)
        return table, found, owners[starts], starts, *smallest(high, low, owners[starts])

    def ask_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        *_, high, low, least, _ = candidates(table, blocks.replies(answers))
        rows = [
            (b, high[s].tobytes() + low[s].tobytes() + least[s].tobytes())
            for b, s in blocks.by_bucket(high, shape.buckets)
        ]
        return blocks.packed(key[0].as_py(), rows)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        first = answers.filter(pa.compute.equal(answers["step"], 1)) if len(answers) else answers
        second = answers.filter(pa.compute.equal(answers["step"], 2)) if len(answers) else answers
        table, found, owners, starts, high, _, least, where = candidates(table, blocks.replies(first))
        earlier = earlier_bits(high, shape.buckets, blocks.replies(second))
        repeated = starts[earlier[where] | (least[where] < owners)]
        gone = words.spread(repeated, window, len(found.starts))
        sums = np.concatenate([[0], np.cumsum(gone)])
        lows, highs = words.runs_of(gone, found.first)
        texts_of = np.searchsorted(found.first, lows, side="right") - 1
        spans = pa.StructArray.from_arrays(
            [
                pa.array((lows - found.first[texts_of]).astype(np.int32)),
                pa.array((highs - found.first[texts_of]).astype(np.int32)),
            ],
            ["start", "end"],
        )
        offsets = np.searchsorted(texts_of, np.arange(len(table) + 1)).astype(np.int32)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(found.counts(), pa.int64()),
                "n_removed": pa.array(np.diff(sums[found.first]), pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans),
                "kept_text": words.joined_words(found, ~gone),
            }
        )

    asked = texts.groupBy("block").applyInArrow(ask_anchors, blocks.ASK)
    anchored = blocks.answered(asked, blocks.shared_answer)
    windows = texts.groupBy("block").cogroup(anchored.groupBy("block")).applyInArrow(ask_windows, blocks.ASK)
    compared = blocks.answered(windows, earlier_answer)
    both = anchored.withColumn("step", F.lit(1)).unionByName(compared.withColumn("step", F.lit(2)))
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, RESULT)


# Which documents hold a window first? Payload: 64 and 32 bits of hash and the smallest doc_id of the block, per window.


def smallest(high: np.ndarray, low: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (high, low) pairs in order, the smallest owner of each, and the place of each given pair."""
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[order], heads) if len(heads) else owners[:0]
    where = np.empty(len(a), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return a[heads], b[heads], least, where


def earlier_answer(payloads: list) -> list[bytes]:
    """One bit per window: an earlier document than those of the block holds it."""
    counts = [len(p) // 20 for p in payloads]
    high = [np.frombuffer(p, np.uint64, n) for p, n in zip(payloads, counts)]
    low = [np.frombuffer(p, np.uint32, n, offset=8 * n) for p, n in zip(payloads, counts)]
    docs = [np.frombuffer(p, np.uint8, 8 * n, offset=12 * n).view(np.int64) for p, n in zip(payloads, counts)]
    every = np.concatenate(docs)
    *_, least, where = smallest(np.concatenate(high), np.concatenate(low), every)
    bits = np.split(least[where] < every, np.cumsum(counts)[:-1])
    return [np.packbits(b).tobytes() for b in bits]


def earlier_bits(high: np.ndarray, buckets: int, answers: list) -> np.ndarray:
    return blocks.shared_bits(high, buckets, answers)
