"""Language identification by mixture inference.

Words are scored by hashed byte trigrams (with a space on either side of the word) under each learned language. A document is a
mixture: expectation-maximisation finds the proportions of languages that make its words most likely. The set of languages is
chosen by penalised likelihood: starting from all, the language with the least share is dropped as long as
that does not lower the likelihood by more than ``penalty`` times half the log of the number of words. The
language with the largest share is the prediction, its share the score.

Training counts trigrams over all texts with a language. What reaches the driver is at most one number per language and
trigram slot, whatever the size of the corpus.

Defined results: a null text, or one without any letter, is ``und`` with score 0. Training passes over rows with null text or
null language; without any language to learn everything is ``und``. Ties go to the first language by code point.
Rows are independent of each other, so repeated ones get equal results. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words

SLOTS = 1 << 16
NOT_LETTER = words.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
RESULT = "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
ROUNDS, MORE_ROUNDS = 8, 4


class LanguageModel(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # log probability, language by slot


def trigram_slots(buffer: np.ndarray) -> np.ndarray:
    """The slot of the three bytes that start at each place of `` text ``: letters lower-cased, all else a space."""
    text = np.full(len(buffer) + 3, 0x20, dtype=np.uint32)
    text[1:-2] = np.where(NOT_LETTER[buffer], np.uint8(0x20), words.LOWER[buffer])
    slots = text[:-2] * np.uint32(0x9E3779B1) + text[1:-1] * np.uint32(0x85EBCA77) + text[2:] * np.uint32(0xC2B2AE3D)
    slots ^= slots >> np.uint32(15)
    return (slots * np.uint32(0x2C1B3C6D)) >> np.uint32(16)


def apart(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space after each, so that trigrams do not cross from one into the next."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full(len(buffer) + len(offsets) - 1, 0x20, dtype=np.uint8)
    out[np.arange(len(buffer)) + owner] = buffer
    return out, offsets + np.arange(len(offsets))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row with a text and a language."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            buffer, offsets = words.text_bytes(batch.column("text"))
            for first, last in words.chunks(offsets):
                at = offsets[first : last + 1]
                part, at = apart(buffer[at[0] : at[-1]], at - at[0])
                found = words.words_of(part, at, NOT_LETTER)
                slots = trigram_slots(part)
                inside = np.zeros(len(slots) + 1, dtype=np.int8)
                inside[found.starts] += 1
                inside[found.ends] -= 1
                used = np.cumsum(inside[:-1]).astype(bool)
                owner = np.searchsorted(at, np.flatnonzero(used), side="right") - 1
                for name in dict.fromkeys(names[first:last]):
                    mine = (names[first:last] == name)[owner]
                    own = np.bincount(slots[used][mine], minlength=SLOTS)
                    counts[name] = counts.get(name, 0) + own
        for name, own in counts.items():
            slots = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(own[slots], pa.int64())],
                ["lang", "slot", "times"],
            )

    named = (F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known = words.in_small_batches(docs).select(*named)
    sums = (
        known.where("text is not null and lang is not null")
        .mapInArrow(count, "lang string, slot int, times long")
        .groupBy("lang", "slot")
        .agg(F.sum("times").alias("times"))
        .toArrow()
    )
    languages = sorted(set(sums["lang"].to_pylist()))
    table = np.full((len(languages), SLOTS), smoothing)
    where = np.searchsorted(languages, sums["lang"].to_pylist()) if languages else []
    table[where, sums["slot"].to_numpy()] += sums["times"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def word_likelihoods(part: np.ndarray, found: words.Words, logs: np.ndarray) -> np.ndarray:
    """Likelihood of each word under each language, relative to the likeliest."""
    slots = trigram_slots(part)
    sums = np.zeros(len(slots) + 1)
    out = np.empty((len(found.starts), len(logs)), dtype=np.float32)
    for k, row in enumerate(logs):
        np.cumsum(row[slots], out=sums[1:], dtype=np.float64)
        out[:, k] = sums[found.ends] - sums[found.starts]
    out -= out.max(axis=1, keepdims=True)
    return np.exp(np.maximum(out, -60.0))


def settle(shares: np.ndarray, likely: np.ndarray, heads: np.ndarray, counts: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation for all documents at once; a share of 0 stays 0."""
    for _ in range(rounds):
        parts = likely * np.repeat(shares, counts, axis=0)
        parts /= parts.sum(axis=1, keepdims=True)
        shares = np.add.reduceat(parts, heads, axis=0) / counts[:, None].astype(np.float32)
    return shares


def fit_of(shares: np.ndarray, likely: np.ndarray, heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log likelihood of each document."""
    every = (likely * np.repeat(shares, counts, axis=0)).sum(axis=1, dtype=np.float64)
    return np.add.reduceat(np.log(np.maximum(every, 1e-300)), heads)


def mixtures(likely: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Shares of the languages in each document; every document has a word."""
    size = likely.shape[1]
    heads = np.cumsum(counts) - counts
    cost = penalty * 0.5 * np.log(np.maximum(counts, 2))
    shares = np.full((len(counts), size), 1 / size, dtype=np.float32)
    shares = settle(shares, likely, heads, counts, ROUNDS)
    fit = fit_of(shares, likely, heads, counts)
    open_ = np.arange(len(counts))
    for left in range(size, 1, -1):
        if not len(open_):
            break
        rows = np.repeat(np.isin(np.arange(len(counts)), open_), counts)
        own, mine = likely[rows], counts[open_]
        first = np.cumsum(mine) - mine
        tried = shares[open_].copy()
        present = np.where(tried > 0, tried, np.inf)
        tried[np.arange(len(open_)), present.argmin(axis=1)] = 0
        total = tried.sum(axis=1, keepdims=True)
        tried = np.where(total > 0, tried / np.maximum(total, 1e-30), shares[open_])
        tried = settle(tried, own, first, mine, MORE_ROUNDS)
        now = fit_of(tried, own, first, mine)
        better = now + cost[open_] >= fit[open_]
        shares[open_[better]] = tried[better]
        fit[open_[better]] = now[better]
        open_ = open_[better]
    return shares


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(
    docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", penalty: float = 2.0
) -> DataFrame:
    """Per row: doc_id, predicted language, its share, and the shares of the chosen languages."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def scan(batches):
        languages, logs = sent.value
        for batch in batches:
            buffer, offsets = words.text_bytes(batch.column("text"))
            for first, last in words.chunks(offsets):
                at = offsets[first : last + 1]
                part, at = apart(buffer[at[0] : at[-1]], at - at[0])
                found = words.words_of(part, at, NOT_LETTER)
                counts = found.counts()
                ascii_letter = np.concatenate([[0], np.cumsum((~NOT_LETTER & (np.arange(256) < 128))[part])])
                spoken = (np.diff(ascii_letter[at]) > 0) & (counts > 0)
                for i in np.flatnonzero(~spoken & (counts > 0)):  # only bytes beyond ASCII: are they letters?
                    spoken[i] = has_letter(part[at[i] : at[i + 1]].tobytes())
                spoken &= len(languages) > 0
                shares = np.zeros((last - first, max(1, len(languages))), dtype=np.float32)
                if spoken.any():
                    likely = word_likelihoods(part, found, logs)[np.repeat(spoken, counts)]
                    shares[spoken] = mixtures(likely, counts[spoken], penalty)
                best = shares.argmax(axis=1)
                score = np.clip(shares[np.arange(len(best)), best].astype(np.float64), 0, 1)
                named = [
                    [{"lang": languages[k], "share": float(row[k])} for k in np.flatnonzero(row)] if ok else []
                    for row, ok in zip(shares, spoken)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array([languages[k] if ok else "und" for k, ok in zip(best, spoken)], pa.string()),
                        pa.array(np.where(spoken, score, 0.0)),
                        pa.array(named, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
                    ],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    source = words.ids_and_texts(docs, doc_id, text)
    return source.mapInArrow(scan, RESULT)
