"""Toxicity by weak supervision.

1. Voters. Fixed lexicons and style patterns, and what is mined from labelled rows: words and word beginnings (the first
   four to eight bytes), occurring once or again in a text, that are much more frequent in toxic texts. A voter fires on a
   document or abstains.
2. Label model. The documents are counted by the pattern of voters that fire. From these counts alone expectation-maximisation
   estimates how often each voter fires on toxic and on other texts. What remains correlated between two voters
   given the label is estimated next, and a voter's evidence is shared among those it is correlated with. A given mark is
   one more voter, which abstains on all texts without one; its rates are estimated likewise, from the texts that have it.
3. Classifier. A logistic regression over the mined features and the voters, trained on the posterior labels.

Labels serve three times: for mining, for the share of toxic texts, and as the voter of marks. All use at most about ``sample``
labelled rows, chosen by a hash of doc_id, one text of each; the label model counts every document. The driver sees one row per voting pattern, at most
``features`` mined features, and the hits of the sampled rows.

Defined results: null and empty texts have no hits and get the score of a text without any. Labels with a null doc_id or a
null mark are passed over; of several labels of one doc_id the highest counts, of several texts the smallest. Without toxic labels only the fixed voters
work. Rows are scored independently, so repeated ones get equal scores. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words

SAMPLE = 12_000
FEATURES = 2_000
HASHES = 1 << 48  # fine enough for any number of labels
NOT_LETTER = words.byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
HEADS = (4, 5, 6, 7, 8)  # bytes of a word's beginning
LEXICONS = (
    ("idiot", "moron", "stupid", "dumb", "fool", "imbecile", "clown"),
    ("loser", "pathetic", "worthless", "useless", "failure"),
    ("scum", "trash", "filth", "vermin", "garbage", "disgusting", "parasite"),
    ("hate", "despise", "kill", "die", "shut", "destroy"),
)
GROUPS = (3, 2, 2)  # voters among which mined words, beginnings, and beginnings that occur again are dealt
STYLES = 2  # runs of exclamation marks, words in capitals
VOTERS = len(LEXICONS) + sum(GROUPS) + STYLES


class Mined(NamedTuple):
    keys: np.ndarray  # sorted hashes of words and beginnings
    once: np.ndarray  # feature of each key where it occurs, or -1
    again: np.ndarray  # feature of each key where it occurs at least twice, or -1
    voters: np.ndarray  # the voter that each feature belongs to


class ToxicityModel(NamedTuple):
    mined: Mined
    weights: np.ndarray  # of features, then of voters
    bias: float


def word_hash(word: str) -> int:
    values = words.BYTE_VALUES[np.frombuffer(word.encode(), np.uint8)]
    return int(words.mix(words.mix(words.run_hashes(values, np.array([0]), np.array([len(values)]))), 60)[0])


def feature_hashes(found: words.Words) -> list[np.ndarray]:
    """Of each kind the hash for every word; 0 where the word is too short."""
    out = [words.mix(found.hashes, 60)]
    lower = words.LOWER[found.buffer]
    padded = np.concatenate([lower, np.zeros(8, np.uint8)])
    sizes = found.ends - found.starts
    head = np.zeros(len(found.starts), dtype=np.uint64)
    for t in range(max(HEADS)):
        head = (head << np.uint64(8)) | padded[found.starts + t]
        if t + 1 in HEADS:
            out.append(np.where(sizes > t + 1, words.mix(head, 61 + t), np.uint64(0)))
    return out


def style_hits(found: words.Words, lower_words: words.Words) -> list[np.ndarray]:
    """Texts with a run of three exclamation marks; texts with three neighbouring words in capitals."""
    b = found.buffer
    marks = np.flatnonzero((b[2:] == 0x21) & (b[1:-1] == 0x21) & (b[:-2] == 0x21)) if len(b) > 2 else np.zeros(0, int)
    loud = np.searchsorted(found.offsets, marks, side="right") - 1
    caps = np.concatenate([[0], np.cumsum((b >= 0x41) & (b <= 0x5A))])
    sizes = found.ends - found.starts
    shouted = (sizes > 2) & (caps[found.ends] - caps[found.starts] == sizes)
    texts = found.texts()
    run = np.flatnonzero(shouted[2:] & shouted[1:-1] & shouted[:-2] & (texts[2:] == texts[:-2])) if len(sizes) > 2 else []
    return [np.bincount(x, minlength=len(found.first) - 1) > 0 for x in (loud.astype(int), texts[run].astype(int))]


LEXICON_KEYS, LEXICON_VOTERS = (
    np.array(x)
    for x in zip(*sorted((np.uint64(word_hash(w)), v) for v, group in enumerate(LEXICONS) for w in group))
)


class Hits(NamedTuple):
    votes: np.ndarray  # text by voter
    rows: np.ndarray  # text of each distinct mined feature that occurs
    features: np.ndarray


def lookup(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur in the sorted array, and where; a small table of bits answers most."""
    if not len(among):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = np.zeros(1 << 16, dtype=bool)
    table[(among & np.uint64(0xFFFF)).astype(np.int64)] = True
    some = np.flatnonzero(table[(keys & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(among, keys[some]), len(among) - 1)
    same = among[at] == keys[some]
    return some[same], at[same]


def hits_of(buffer: np.ndarray, offsets: np.ndarray, mined: Mined) -> Hits:
    found = words.words_of(buffer, offsets, NOT_LETTER, lower=True)
    texts, count = found.texts(), len(offsets) - 1
    votes = np.zeros((count, VOTERS), dtype=bool)
    rows, features = [], []
    for kind, keys in enumerate(feature_hashes(found)):
        if kind == 0:
            word, at = lookup(keys, LEXICON_KEYS)
            votes[texts[word], LEXICON_VOTERS[at]] = True
        word, at = lookup(keys, mined.keys)
        pair, times = np.unique(texts[word] * max(1, len(mined.keys)) + at, return_counts=True)
        own, at = np.divmod(pair, max(1, len(mined.keys)))
        for chosen in (mined.once[at], np.where(times > 1, mined.again[at], -1)):
            rows.append(own[chosen >= 0])
            features.append(chosen[chosen >= 0])
    row, feature = np.concatenate(rows), np.concatenate(features)
    votes[row, mined.voters[feature]] = True
    for k, fired in enumerate(style_hits(found, found)):
        votes[:, VOTERS - STYLES + k] = fired
    order = np.lexsort((feature, row))
    return Hits(votes, row[order], feature[order])


def text_chunks(batches, column: str = "text"):
    for batch in batches:
        buffer, offsets = words.text_bytes(batch.column(column))
        for first, last in words.chunks(offsets):
            at = offsets[first : last + 1]
            yield batch.slice(first, last - first), buffer[at[0] : at[-1]], at - at[0]


def one_of_each(sampled: DataFrame) -> DataFrame:
    """One row of each group of copies, which would lend their words a false weight.

    Copies have equal sequences of words and numbers, whatever stands between them and however it is capitalised; a text
    without any is a copy of equal texts only.
    """
    sequence = F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]+", " "))
    own = F.sha2(F.when(sequence != "", sequence).otherwise(F.concat(F.lit(" "), F.col("text"))), 256)
    return sampled.groupBy(own.alias("own"), "toxic").agg(F.min("text").alias("text")).drop("own")


def mine(sampled: DataFrame, limit: int) -> Mined:
    """The features that speak most for toxic texts, dealt among their voters."""

    def count(batches):
        for rows, buffer, offsets in text_chunks(batches):
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            found = words.words_of(buffer, offsets, NOT_LETTER, lower=True)
            for kind, keys in enumerate(feature_hashes(found)):
                order = np.lexsort((keys, found.texts()))
                keys, texts = keys[order], found.texts()[order]
                new = np.ones(len(keys) + 1, dtype=bool)
                new[1:-1] = (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])
                heads = np.flatnonzero(new)
                times, keys, texts = np.diff(heads), keys[heads[:-1]], texts[heads[:-1]]
                for own, chosen in ((min(kind, 1), keys != 0), (2, (keys != 0) & (times > 1) & (kind > 0))):
                    every, where = np.unique(keys[chosen], return_inverse=True)
                    bad = np.bincount(where, weights=toxic[texts[chosen]], minlength=len(every)).astype(np.int64)
                    good = np.bincount(where, minlength=len(every)) - bad
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([own] * len(every), pa.int32()),
                            pa.array(every.view(np.int64)),
                            pa.array(bad),
                            pa.array(good),
                        ],
                        ["kind", "feature", "bad", "good"],
                    )

    total = sampled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        none = np.zeros(0, np.int64)
        return Mined(none.astype(np.uint64), none, none, none)
    rate_bad = (F.col("bad") + 0.1) / total["bad"]
    rate_good = (F.col("good") + 0.5) / total["good"]
    found = (
        sampled.mapInArrow(count, "kind int, feature long, bad long, good long")
        .groupBy("kind", "feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(F.col("bad") >= 3)
        .withColumn("odds", F.log(rate_bad / rate_good) - 1.64 * F.sqrt(1 / F.col("bad") + 1 / (F.col("good") + 0.5)))
        .where(F.col("odds") >= 2.5)  # the lower bound of the log odds
        .orderBy(F.col("odds").desc(), "feature", "kind")
        .limit(limit)
        .select("kind", "feature")
        .toArrow()
    )
    keys = found["feature"].to_numpy().view(np.uint64)  # sorted by odds, so the number of a feature is its rank
    kinds = found["kind"].to_numpy()
    bases = len(LEXICONS) + np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
    voters = bases[kinds] + (words.mix(keys, 70) % np.array(GROUPS, np.uint64)[kinds]).astype(np.int64)
    every, where = np.unique(keys, return_inverse=True)
    once, again = np.full((2, len(every)), -1)
    once[where[kinds < 2]] = np.flatnonzero(kinds < 2)
    again[where[kinds == 2]] = np.flatnonzero(kinds == 2)
    return Mined(every, once, again, voters)


class LabelModel(NamedTuple):
    prior: float
    weights: np.ndarray  # evidence of each voter that fires, and of each that does not
    accuracies: np.ndarray  # firing rate on toxic and on other texts
    correlations: np.ndarray  # of the voters given the label


def label_model(patterns: np.ndarray, times: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Estimate rates and correlations of the voters from the counts of their patterns (pattern by voter)."""
    prior = min(max(prior, 1e-3), 0.5)
    fired = patterns.astype(float)
    strength = fired.sum(axis=1)
    # start: of the texts on which most voters fire, as many as the prior says are toxic
    order = np.argsort(-strength, kind="stable")
    belief = np.where(np.cumsum(times[order]) <= max(prior * times.sum(), times[order[0]]), 0.95, 0.02)[np.argsort(order)]
    belief[strength == 0] = 0.01
    for _ in range(rounds):
        bad, good = times * belief, times * (1 - belief)
        rate_bad = (bad @ fired + 0.5) / (bad.sum() + 1)
        rate_good = (good @ fired + 0.5) / (good.sum() + 1)
        yes = np.log(rate_bad / rate_good)
        no = np.log((1 - rate_bad) / (1 - rate_good))
        rest = [(fired - rate) * np.sqrt(w / w.sum())[:, None] for rate, w in ((rate_bad, bad), (rate_good, good))]
        covariance = prior * rest[0].T @ rest[0] + (1 - prior) * rest[1].T @ rest[1]
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        correlations = covariance / np.outer(spread, spread)
        np.fill_diagonal(correlations, 1.0)
        share = 1 / np.maximum((np.clip(correlations, 0, 1) ** 2).sum(axis=1), 1.0)
        weights = np.stack([yes * share, no * share])
        belief = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + fired @ weights[0] + (1 - fired) @ weights[1], -30, 30)))
    return LabelModel(prior, weights, np.stack([rate_bad, rate_good]), correlations)


def posterior(votes: np.ndarray, model: LabelModel) -> np.ndarray:
    fired = votes.astype(float)
    odds = np.log(model.prior / (1 - model.prior)) + fired @ model.weights[0] + (1 - fired) @ model.weights[1]
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def with_marks(belief: np.ndarray, marks: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The posterior once the marks vote too, at the rates that agree with it."""
    odds = np.log(np.clip(belief, 1e-12, 1 - 1e-12)) - np.log(np.clip(1 - belief, 1e-12, 1 - 1e-12))
    for _ in range(rounds):
        rate_bad = (belief @ marks + 0.5) / (belief.sum() + 1)
        rate_good = ((1 - belief) @ marks + 0.5) / ((1 - belief).sum() + 1)
        evidence = np.where(marks > 0, np.log(rate_bad / rate_good), np.log((1 - rate_bad) / (1 - rate_good)))
        belief = 1 / (1 + np.exp(-np.clip(odds + evidence, -30, 30)))
    return belief


def regression(hits: Hits, count: int, labels: np.ndarray, ridge: float = 0.5, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on features and voters, by gradient steps scaled per weight."""
    rows = np.concatenate([hits.rows, np.nonzero(hits.votes)[0]])
    columns = np.concatenate([hits.features, count + np.nonzero(hits.votes)[1]])
    weights, bias = np.zeros(count + VOTERS), 0.0
    seen, seen_bias = np.full(len(weights), 1e-6), 1e-6
    for _ in range(rounds):
        odds = np.bincount(rows, weights=weights[columns], minlength=len(labels)) + bias
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels
        slope = np.bincount(columns, weights=error[rows], minlength=len(weights)) + ridge * weights
        seen += slope**2
        seen_bias += error.sum() ** 2
        weights -= 0.5 * slope / np.sqrt(seen)
        bias -= 0.5 * error.sum() / np.sqrt(seen_bias)
    return weights, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label_id: str = "doc_id",
    mark: str = "toxic",
    sample: int = SAMPLE,
    features: int = FEATURES,
) -> ToxicityModel:
    """Learn from the documents and from labels (1 toxic, 0 not); the caller keeps held-out labels back."""
    context = docs.sparkSession.sparkContext
    marks = (
        labels.where(F.col(label_id).isNotNull() & F.col(mark).isNotNull())
        .groupBy(F.col(label_id).cast("long").alias("_id"))
        .agg(F.max(F.col(mark).cast("int")).alias("toxic"))
    )
    known = marks.count()
    share = min(1.0, sample / max(known, 1))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit(6), "_id"), F.lit(HASHES)) < int(share * HASHES))
    texts = words.ids_and_texts(docs, doc_id, text).withColumnRenamed("doc_id", "_id")
    sampled = (
        texts.join(F.broadcast(chosen), "_id")  # about ``sample`` rows of two numbers
        .groupBy("_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
        .select("text", "toxic")
    )
    mined = mine(one_of_each(sampled), features)
    sent = context.broadcast(tuple(mined))
    powers = 1 << np.arange(VOTERS, dtype=np.int64)

    def vote(batches):
        for _, buffer, offsets in text_chunks(batches):
            patterns, times = np.unique(hits_of(buffer, offsets, Mined(*sent.value)).votes @ powers, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns), pa.array(times)], ["pattern", "times"])

    def observe(batches):
        for rows, buffer, offsets in text_chunks(batches):
            hits = hits_of(buffer, offsets, Mined(*sent.value))
            places = np.searchsorted(hits.rows, np.arange(len(offsets))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hits.votes @ powers),
                    pa.ListArray.from_arrays(pa.array(places), pa.array(hits.features.astype(np.int32))),
                    rows.column("toxic"),
                ],
                ["pattern", "features", "toxic"],
            )

    counts = (
        texts.select("text").mapInArrow(vote, "pattern long, times long").groupBy("pattern").agg(F.sum("times").alias("times"))
    ).toArrow()
    observed = sampled.mapInArrow(observe, "pattern long, features array<int>, toxic int").toArrow()
    bits = lambda column: (column.to_numpy()[:, None] >> np.arange(VOTERS)) & 1 == 1
    if not counts.num_rows:
        return ToxicityModel(mined, np.zeros(len(mined.voters) + VOTERS), -3.0)
    order = np.argsort(counts["pattern"].to_numpy())
    seen = sorted(zip(*(observed[name].to_pylist() for name in ("pattern", "features", "toxic"))))  # reruns sum alike
    observed = pa.Table.from_pylist(
        [dict(zip(("pattern", "features", "toxic"), row)) for row in seen], observed.schema
    )
    toxic = observed["toxic"].to_numpy()
    prior = float(toxic.mean()) if len(toxic) else 0.05
    model = label_model(bits(counts["pattern"])[order], counts["times"].to_numpy()[order], prior)
    if not len(toxic):  # nothing to train on: the evidence of the voters themselves
        weights = np.concatenate([np.zeros(len(mined.voters)), model.weights[0] - model.weights[1]])
        return ToxicityModel(mined, weights, float(np.log(model.prior / (1 - model.prior)) + model.weights[1].sum()))
    votes = bits(observed["pattern"])
    lists = observed["features"].combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    hits = Hits(votes, rows, lists.flatten().to_numpy().astype(np.int64))
    return ToxicityModel(mined, *regression(hits, len(mined.voters), with_marks(posterior(votes, model), toxic)))


def received(sent: tuple) -> ToxicityModel:
    return ToxicityModel(Mined(*sent[0]), *sent[1:])


def scores(buffer: np.ndarray, offsets: np.ndarray, model: ToxicityModel) -> np.ndarray:
    hits = hits_of(buffer, offsets, model.mined)
    size = len(model.mined.voters)
    odds = hits.votes @ model.weights[size:] + model.bias
    odds += np.bincount(hits.rows, weights=model.weights[hits.features], minlength=len(offsets) - 1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and the probability that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast((tuple(model.mined), model.weights, model.bias))

    def scan(batches):
        for rows, buffer, offsets in text_chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(scores(buffer, offsets, received(sent.value)))], ["doc_id", "score"]
            )

    source = words.ids_and_texts(docs, doc_id, text)
    return source.mapInArrow(scan, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast((tuple(model.mined), model.weights, model.bias))

    def scan(batches):
        for rows, buffer, offsets in text_chunks(batches, text):
            yield rows.filter(pa.array(scores(buffer, offsets, received(sent.value)) < threshold))

    return words.in_small_batches(docs).mapInArrow(scan, docs.schema)
