"""Benchmark decontamination by winnowed fingerprints.

Of every ``window - gram + 1`` neighbouring grams of ``gram`` words, the one with the least hash (the last of equal ones) is
a fingerprint. Equal runs of ``window`` words select the same fingerprint at the same place, so every shared run of that
length shows up in a join of the fingerprints of documents and items; each hit is extended word by word, up to the
window in either direction, and counts only for the windows that agree throughout.
Items shorter than the window are matched whole, by their full sequence of words at every position.

Equal texts of items are indexed once, and so are equal surroundings of a fingerprint (all words that its windows can reach), with
the list of their items; a passage that thousands of items share is compared once. The texts are read in slices of about
``slice_bytes``; the index of one slice is sent to all tasks at a time, so a larger benchmark takes more passes
over the documents instead of more memory.

Defined results: null and empty texts have no words; a document without words is not contaminated, an item without words
never occurs. Rows with one doc_id get a result each. Items that share an item_id count once. An item with a null id
marks words but is not listed. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words
from tidelog.session import shared_dir

SLICE_BYTES = 16 << 20
NAMES = 10_000
RESULT = "doc_id long, row long, n_words long, hits array<struct<start: int, end: int>>, items array<string>"


class Index(NamedTuple):
    """Fingerprints of a slice of items, and what is needed to extend a hit.

    An entry is a fingerprint with its surroundings, or a short text; it belongs to one or more texts, and a text to one or
    more items.
    """

    prints: np.ndarray  # sorted hashes, of the first entries
    places: np.ndarray  # the word at which each starts
    hashes: np.ndarray  # word hashes of all items
    ends: np.ndarray  # word after the last one of the item, for each word
    starts: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: sorted distinct hashes, entry
    bounds: np.ndarray  # where the texts of each entry begin in ``owners``
    owners: np.ndarray
    names: list[list[str | None]]  # of the items of each text


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one of each distinct key, in order of the keys; where each begins in the order; the order."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    heads = np.flatnonzero(new)
    return order[heads], heads, order


def fingerprints(hashes: np.ndarray, first: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected grams of every text with at least ``window`` words."""
    span = window - gram + 1
    grams = words.mix(words.gram_hashes(hashes, gram), 8)
    if len(grams) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # the position, counted down, in the low half makes the last of equal hashes the least
    size = len(grams)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(size - 1) - np.arange(size, dtype=np.uint64))
    chosen = size - 1 - (words.sliding_min(order, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.diff(first)
    place = np.arange(len(hashes)) - np.repeat(first[:-1], counts)
    whole = (place + window <= np.repeat(counts, counts))[: len(chosen)]
    at = np.unique(chosen[whole])
    return at, grams[at]


def build_index(names: list[list[str | None]], texts: pa.Array, gram: int, window: int) -> Index:
    """The index of distinct texts, each with the names of its items."""
    found = words.words_of(*words.text_bytes(texts), words.NOT_ALNUM, lower=True)
    counts = found.counts()
    starts, ends = np.repeat(found.first[:-1], counts), np.repeat(found.first[1:], counts)
    at, prints = fingerprints(found.hashes, found.first, gram, window)
    low, high = np.maximum(starts[at], at - (window - gram)), np.minimum(ends[at], at + window)
    shape = ((at - low) * (window + 1) + high - at).astype(np.uint64)
    around = words.mix(words.mix(words.run_hashes(found.hashes, low, high), 10) + shape, 11)
    one, heads, order = grouped(around)
    by_print = np.argsort(prints[one], kind="stable")
    bounds, owners = [heads], [found.texts()[at[order]]]  # of the entries in order of their surroundings
    entries, listed = len(one), len(order)
    short = {}
    for n in np.unique(counts[(counts > 0) & (counts < window)]):
        own = np.flatnonzero(counts == n)
        hashes = words.mix(words.gram_hashes(found.hashes, int(n))[found.first[own]], 9)
        first, begins, by = grouped(hashes)
        short[int(n)] = (hashes[first], entries + np.arange(len(first)))
        bounds.append(listed + begins)
        owners.append(own[by])
        entries, listed = entries + len(first), listed + len(by)
    owner = np.concatenate(owners).astype(np.int64)
    bounds = np.append(np.concatenate(bounds).astype(np.int64), len(owner))
    # entries of fingerprints are numbered by their place in ``prints``
    renumbered = np.concatenate([by_print, np.arange(len(one), entries)]).astype(np.int64)
    lists = [np.unique(owner[bounds[e] : bounds[e + 1]]) for e in renumbered]
    return Index(
        prints[one][by_print],
        at[one][by_print],
        found.hashes,
        ends,
        starts,
        short,
        np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64),
        np.concatenate([np.zeros(0, np.int64), *lists]),
        names,
    )


def pairs(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with keys[i] == among[j]; among is sorted."""
    low, high = np.searchsorted(among, keys, "left"), np.searchsorted(among, keys, "right")
    counts = high - low
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(np.arange(len(keys)), counts), np.arange(total) + np.repeat(low - (ends - counts), counts)


def matches(found: words.Words, index: Index, gram: int, window: int, at_once: int = 1 << 18):
    """Start, length and entry of every document window that equals one of an item, in portions."""
    counts = found.counts()
    begin, end = np.repeat(found.first[:-1], counts), np.repeat(found.first[1:], counts)
    at, prints = fingerprints(found.hashes, found.first, gram, window)
    known = np.isin(prints, index.prints)
    at, prints = at[known], prints[known]
    step = max(1, at_once // max(1, int(np.max(np.unique(index.prints, return_counts=True)[1], initial=1))))
    for low in range(0, len(at), step):
        i, j = pairs(prints[low : low + step], index.prints)
        here, there = at[low : low + step][i], index.places[j]
        for back in range(window - gram + 1):
            d, q = here - back, there - back
            inside = (d >= begin[here]) & (d + window <= end[here])
            inside &= (q >= index.starts[there]) & (q + window <= index.ends[there])
            d, q, entry = d[inside], q[inside], j[inside]
            for t in range(window):
                same = found.hashes[d + t] == index.hashes[q + t]
                d, q, entry = d[same], q[same], entry[same]
            yield d, window, entry
    for n, (hashes, entries) in index.short.items():
        grams = words.mix(words.gram_hashes(found.hashes, n), 9)
        place = np.flatnonzero(np.isin(grams, hashes))
        place = place[place + n <= end[place]]
        i, j = pairs(grams[place], hashes)
        yield place[i], n, entries[j]


def sliced(items: DataFrame, item_id: str, item_text: str, slice_bytes: int) -> tuple[DataFrame, int]:
    """Distinct texts with the names of their items and the number of their slice; and how many slices there are.

    The names of a text are dealt into rows of about ``NAMES`` of them, so that many items of one text spread over slices.
    """
    named = items.select(
        F.col(item_id).cast("string").alias("name"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")
    ).distinct()
    few = F.pmod(F.xxhash64("name"), F.lit(named.count() // NAMES + 1)).alias("part")
    lists = named.groupBy("text", few).agg(F.collect_list(F.struct("name")).alias("names"))
    size = F.octet_length("text") + 16 * F.size("names")
    slices = int(lists.agg(F.sum(size)).first()[0] or 0) // (slice_bytes // 2) + 1  # half as a margin for uneven slices
    dealt = F.pmod(F.xxhash64("text", "part"), F.lit(slices)).alias("slice")
    return lists.select("text", F.col("names.name").alias("names"), dealt), slices


def index_of(rows: DataFrame, number: int, gram: int, window: int):
    """The index of one slice, as a broadcast variable."""
    part = rows.where(F.col("slice") == number).toArrow()
    index = build_index(part["names"].to_pylist(), part["text"], gram, window)
    return rows.sparkSession.sparkContext.broadcast(tuple(index))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    gram: int = 5,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Per document its number of words, the word ranges [start, end) hit by item windows, and the items that occur."""
    if not 1 <= gram <= window:
        raise ValueError("a window holds at least one gram")
    rows, slices = sliced(items, item_id, item_text, slice_bytes)
    row = F.xxhash64(doc_id, text) if slices > 1 else F.lit(0).cast("long")  # names a row in the results of all passes
    source = words.in_small_batches(docs).select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), row.alias("row")
    )

    def pass_over(sent) -> DataFrame:
        def scan(batches):
            index = Index(*sent.value)
            for batch in batches:
                buffer, offsets = words.text_bytes(batch.column("text"))
                for first, last in words.chunks(offsets):
                    at = offsets[first : last + 1]
                    found = words.words_of(buffer[at[0] : at[-1]], at - at[0], words.NOT_ALNUM, lower=True)
                    yield results(batch.slice(first, last - first), found, index, gram, window)

        return source.mapInArrow(scan, RESULT)

    if slices == 1:
        return pass_over(index_of(rows, 0, gram, window)).drop("row")
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    passes = []
    for number in range(slices):
        sent = index_of(rows, number, gram, window)
        passes.append(pass_over(sent).checkpoint())
        sent.unpersist()
    return merged(passes)


def merged(passes: list[DataFrame]) -> DataFrame:
    """One result per row of the documents from those of all passes; ranges that touch become one."""
    every = passes[0]
    for one in passes[1:]:
        every = every.unionByName(one)
    grouped = every.groupBy("doc_id", "row").agg(
        F.max("n_words").alias("n_words"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )

    def joined(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"], F.greatest(last["end"], span["end"])).cast("struct<start: int, end: int>")
        return F.when(
            (F.size(done) > 0) & (last["end"] >= span["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider)),
        ).otherwise(F.concat(done, F.array(span)))

    none = F.array().cast("array<struct<start: int, end: int>>")
    return grouped.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", none, joined).alias("hits"),
        "items",
        F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"),
    ).drop("copy")


def texts_of(documents: np.ndarray, entries: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """The distinct texts of the entries that occur in each document, by document."""
    counts = index.bounds[entries + 1] - index.bounds[entries]
    ends = np.cumsum(counts)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(index.bounds[entries] - (ends - counts), counts)
    count = max(1, len(index.names))
    return np.divmod(np.unique(np.repeat(documents, counts) * count + index.owners[at]), count)


def results(batch: pa.RecordBatch, found: words.Words, index: Index, gram: int, window: int) -> pa.RecordBatch:
    hit = np.zeros(len(found.starts), dtype=bool)
    seen = []
    texts = found.texts()
    entries = len(index.bounds) - 1
    for starts, length, entry in matches(found, index, gram, window):
        hit |= words.spread(starts, length, len(hit)) if len(starts) else False
        seen.append(np.unique(texts[starts] * entries + entry))
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *seen]))
    owners, items = texts_of(*np.divmod(every, max(1, entries)), index)
    lows, highs = words.runs_of(hit, found.first)
    owner = np.searchsorted(found.first, lows, side="right") - 1
    rows = np.arange(len(batch) + 1)
    spans = pa.StructArray.from_arrays(
        [
            pa.array((lows - found.first[owner]).astype(np.int32)),
            pa.array((highs - found.first[owner]).astype(np.int32)),
        ],
        ["start", "end"],
    )
    parts = np.split(items, np.searchsorted(owners, rows[1:-1]))
    names = [sorted({name for i in part for name in index.names[i]} - {None}) for part in parts]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            batch.column("row"),
            pa.array(found.counts(), pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, rows).astype(np.int32)), spans),
            pa.array(names, pa.list_(pa.string())),
        ],
        ["doc_id", "row", "n_words", "hits", "items"],
    )


def keep_clean(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    gram: int = 5,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The documents in which no item window occurs, with all their columns."""
    rows, slices = sliced(items, item_id, item_text, slice_bytes)
    for number in range(slices):
        sent = index_of(rows, number, gram, window)

        def scan(batches, sent=sent):
            own = Index(*sent.value)
            for batch in batches:
                buffer, offsets = words.text_bytes(batch.column(text))
                for first, last in words.chunks(offsets):
                    at = offsets[first : last + 1]
                    found = words.words_of(buffer[at[0] : at[-1]], at - at[0], words.NOT_ALNUM, lower=True)
                    dirty = np.zeros(last - first, dtype=bool)
                    for starts, _, _ in matches(found, own, gram, window):
                        dirty[found.texts()[starts]] = True
                    yield batch.slice(first, last - first).filter(pa.array(~dirty))

        docs = words.in_small_batches(docs).mapInArrow(scan, docs.schema)
        if slices > 1:
            shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
            docs = docs.checkpoint()
            sent.unpersist()
    return docs
