"""License scans: an inverted index of winnowed fingerprints of the templates, then banded alignment of the candidates.

Templates and documents are winnowed alike (grams of ``gram`` words, the least hash of ``span`` neighbours), so a common run of
``gram + span - 1`` words agrees in a fingerprint. An entry of the index is (fingerprint, template, place), and one that occurs in a
document gives a candidate: the template laid over the document at the place where the two agree. Where no words are
inserted, n words of which e are missing share a run of at least (n - e) / (e + 1). For templates so short, or
matches with so many gaps, that no such run is sure, candidates come from rare words as well: of any ``e + 1`` words of the
template a match has one, so the rarest ``e + 1`` (by number of templates, then the longer) are indexed besides. ``by`` tells how a match
was found: ``fingerprint``, or ``word`` where no fingerprint led to it.
Candidates near which too few words of the template lie are dropped. Around each of the others the template is
aligned word by word, at every offset up to ``band`` from it and with up to ``band`` inserted or missing words on either
side; a match is an alignment that covers at least ``coverage`` of the template's words.

Templates are a parameter, read once and sent to all tasks: at most ``LIMIT_BYTES`` of text, more is refused.

Defined results: null and empty texts have no match. Matches of one template in one document do not overlap: the one with
the higher coverage stays, then the earlier. Rows are independent, so repeated ones get equal matches. A template
without words matches nothing. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm import words
from tidelog.llm.decontaminate import fingerprints, pairs
from tidelog.llm.toxicity import lookup

LIMIT_BYTES = 8 << 20
RESULT = "doc_id long, matches array<struct<license: string, coverage: double, matched: int, start: int, end: int, by: string>>"
MATCH = pa.struct(
    [
        ("license", pa.string()),
        ("coverage", pa.float64()),
        ("matched", pa.int32()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("by", pa.string()),
    ]
)

# Usual notices, in the wording their stewards publish.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    (
        "Apache-2.0-header",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "GPL-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "BSD-text",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
]


def align(
    text: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, template: np.ndarray, band: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of a template near each start: matched words, first and last + 1 word of the text.

    A match earns 2, any other step costs 1. Cell (i, j) has template word i against text word start + i + j - band.
    """
    width, count = 2 * band + 1, len(starts)
    score = np.zeros((count, width + 2), dtype=np.int32)  # a column of its own on either side, never entered
    hits = np.zeros_like(score)
    begin = np.zeros_like(score)
    best = np.zeros((3, count), dtype=np.int64)
    top = np.zeros(count, dtype=np.int32)
    for i, word in enumerate(template):
        now, now_hits, now_begin = np.zeros_like(score), np.zeros_like(hits), np.zeros_like(begin)
        for j in range(1, width + 1):
            at = starts + i + (j - 1) - band
            inside = (at >= low) & (at < high)
            same = inside & (text[np.clip(at, 0, len(text) - 1)] == word)
            options = (
                (score[:, j] + np.where(same, 2, -1), hits[:, j] + same, np.where(score[:, j] > 0, begin[:, j], at)),
                (score[:, j + 1] - 1, hits[:, j + 1], begin[:, j + 1]),
                (now[:, j - 1] - 1, now_hits[:, j - 1], now_begin[:, j - 1]),
            )
            value, own, first = options[0]
            for more, more_hits, more_first in options[1:]:
                better = more > value
                value, own, first = (
                    np.where(better, more, value),
                    np.where(better, more_hits, own),
                    np.where(better, more_first, first),
                )
            good = inside & (value > 0)
            now[:, j], now_hits[:, j], now_begin[:, j] = np.where(good, value, 0), np.where(good, own, 0), first
            record = now[:, j] > top
            top = np.where(record, now[:, j], top)
            best[:, record] = np.stack([now_hits[record, j], now_begin[record, j], at[record] + 1])
        score, hits, begin = now, now_hits, now_begin
    return best[0], best[1], best[2]


def indexed(
    known: words.Words, wanted: np.ndarray, gram: int, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all templates; places of the rarest words wanted of each; places and hashes of the fingerprints."""
    vocabulary, term = np.unique(known.hashes, return_inverse=True)
    owner = known.texts()
    used = np.bincount(np.unique(np.stack([term, owner]), axis=1)[0], minlength=len(vocabulary))
    order = np.lexsort((np.arange(len(term)), -(known.ends - known.starts), used[term], owner))
    rank = np.arange(len(term)) - known.first[owner]  # the order keeps the words of a template together
    return vocabulary, order[rank < wanted[owner]], *fingerprints(known.hashes, known.first, gram, window)


def unique_pairs(document: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.unique(np.stack([document, start]), axis=1)
    return found[0], found[1]


def enough(
    terms: np.ndarray,
    member: np.ndarray,
    first: np.ndarray,
    document: np.ndarray,
    start: np.ndarray,
    size: int,
    slack: int,
    need: int,
    at_once: int = 1 << 20,
) -> np.ndarray:
    """Starts around which, ``slack`` words to either side included, the document has ``need`` words of the template."""
    width = size + 2 * slack
    step = max(1, at_once // width)
    out = np.zeros(len(start), dtype=bool)
    for low in range(0, len(start), step):
        part = slice(low, low + step)
        at = start[part, None] - slack + np.arange(width)
        inside = (at >= first[document[part], None]) & (at < first[document[part] + 1, None])
        out[part] = (member[terms[np.clip(at, 0, len(terms) - 1)]] & inside).sum(axis=1) >= need
    return np.flatnonzero(out)


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    doc_id: str = "doc_id",
    text: str = "text",
    gram: int = 2,
    span: int = 3,
    band: int = 4,
    coverage: float = 0.8,
) -> DataFrame:
    """Per row: doc_id and the matches, each with the license, share and number of matched words, and word range."""
    if sum(len(t.encode()) for _, t in templates) > LIMIT_BYTES:
        raise ValueError("the templates are too large to send to every task")
    names = [n for n, _ in templates]
    known = words.words_of(*words.text_bytes(pa.array([t for _, t in templates], pa.string())), words.NOT_ALNUM, lower=True)
    sizes = known.counts()
    need = np.maximum(np.ceil(coverage * sizes).astype(np.int64), 1)
    missing = sizes - need
    # a gap between two runs of a match misses words or inserts some; what is inserted and not missed leaves the band in the end
    winnowed = need > (gram + span - 2) * (2 * missing + 2 * band + 1)
    vocabulary, at, prints_at, prints = indexed(known, np.where(winnowed, 0, missing + 1), gram, gram + span - 1)
    lists = []
    for keys, where in ((np.searchsorted(vocabulary, known.hashes[at]), at), (prints, prints_at)):
        order = np.argsort(keys, kind="stable")
        owner = known.texts()[where[order]]
        lists.append((keys[order], owner, where[order] - known.first[owner]))
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, lists, known.hashes, known.first, need))

    def matches(found: words.Words) -> list[list[dict]]:
        vocabulary, lists, hashes, first, need = sent.value
        out: list[list[dict]] = [[] for _ in found.counts()]
        if not len(found.starts) or not len(vocabulary):
            return out
        here, ids = lookup(found.hashes, vocabulary)
        terms = np.full(len(found.hashes), len(vocabulary))
        terms[here] = ids
        hits = [(here, ids)]
        if len(lists[1][0]):
            hits.append(fingerprints(found.hashes, found.first, gram, gram + span - 1))
        laid = []
        for (at, keys), (index, owner, place) in zip(hits, lists):
            some = np.isin(keys, index)
            i, j = pairs(keys[some], index)
            at = at[some][i]
            laid.append((owner[j], np.searchsorted(found.first, at, side="right") - 1, at - place[j]))
        template, document, start = (np.concatenate(x) for x in zip(*laid))
        printed = np.repeat([i == 1 for i in range(len(laid))], [len(x[0]) for x in laid])
        for t in np.unique(template):
            own = hashes[first[t] : first[t + 1]]
            mine = template == t
            where, begins = unique_pairs(document[mine], start[mine])
            by_print = set(zip(document[mine & printed].tolist(), start[mine & printed].tolist()))
            member = np.zeros(len(vocabulary) + 1, dtype=bool)
            member[np.searchsorted(vocabulary, own)] = True
            near = enough(terms, member, found.first, where, begins, len(own), 2 * band, need[t])
            offsets = np.arange(-band, band + 1)
            where, begins = unique_pairs(
                np.repeat(where[near], len(offsets)), (begins[near][:, None] + offsets).ravel()
            )
            near = enough(terms, member, found.first, where, begins, len(own), band, need[t])
            where, begins = where[near], begins[near]
            matched, begin, end = align(found.hashes, found.first[where], found.first[where + 1], begins, own, band)
            size = int(first[t + 1] - first[t])
            good = np.flatnonzero(matched >= coverage * size)
            for d, m, b, e in sorted(
                zip(where[good], matched[good], begin[good], end[good]), key=lambda x: (x[0], -x[1], x[2], x[3])
            ):
                base = int(found.first[d])
                b, e = int(b) - base, int(e) - base
                if any(x["license"] == names[t] and b < x["end"] and x["start"] < e for x in out[d]):
                    continue
                # a start of the alignment lies at most ``band`` from that of the candidate, and its first word as far again
                led = any((d, base + b + o) in by_print for o in range(-2 * band - size + int(m), 2 * band + 1))
                out[d].append(
                    {
                        "license": names[t],
                        "coverage": int(m) / size,
                        "matched": int(m),
                        "start": b,
                        "end": e,
                        "by": "fingerprint" if led else "word",
                    }
                )
        return out

    def scan(batches):
        for batch in batches:
            buffer, offsets = words.text_bytes(batch.column("text"))
            for low, high in words.chunks(offsets):
                cut = offsets[low : high + 1]
                found = words.words_of(buffer[cut[0] : cut[-1]], cut - cut[0], words.NOT_ALNUM, lower=True)
                listed = [sorted(m, key=lambda x: (x["start"], x["end"], x["license"])) for m in matches(found)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), pa.array(listed, pa.list_(MATCH))],
                    ["doc_id", "matches"],
                )

    source = words.ids_and_texts(docs, doc_id, text)
    return source.mapInArrow(scan, RESULT)
