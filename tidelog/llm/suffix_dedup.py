"""Suffix-array dedup of byte strings that an earlier document also holds.

Strings of ``length`` bytes are compared through suffix arrays, in three steps over blocks of documents.

1. Each string has an anchor: its ``gram`` bytes with the least hash, which depend on the string alone. Blocks ask which
   anchors two documents hold; text whose anchors are held once cannot repeat and goes no further.
2. The strings that one anchor serves lie in one snippet of the text. Snippets go to the shard of their anchor, once per
   block, with the smallest doc_id that holds them there. Equal snippets become one. Where an anchor has several, a shard
   builds their suffix array by prefix doubling (Larsson-Sadakane: only groups that are still equal are sorted again), takes
   the common prefixes of neighbours from Kasai's walk, and so finds the classes of equal strings and the smallest doc_id of
   each. A hot shard is cut into pieces of bounded size, whose sorted classes are merged by binary search.
3. Each block learns, by one bit per string, which strings an earlier document of another block holds, and cuts the texts.

Defined results: null text is empty. Rows with one doc_id count as one document: they do not remove from each other,
and each row gets its own result. A null doc_id comes after all others: such rows lose what any other document holds
and take nothing away. Other columns are not read. Texts shorter than ``length`` bytes are kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import blocks, words

RESULT = "doc_id long, n_bytes long, n_removed long, removed array<struct<start: int, end: int>>, kept binary"
INDEX_BITS = 20  # of a position in a shard: three of them share a 64-bit sort key
PIECE = (1 << INDEX_BITS) - 2


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, gram: int = 20
) -> DataFrame:
    """Per document the bytes left when each byte goes that is covered by a string which starts in an earlier document.

    ``removed`` has the byte ranges [start, end), ``kept`` the other bytes.
    """
    if not 1 <= gram <= length or length - gram >= 32:
        raise ValueError("a string holds a gram, and at most 32 of them")
    if 2 * length - gram > PIECE // 2:
        raise ValueError("a suffix array holds two snippets at least")
    shape = blocks.layout(docs, text, 0.07)
    texts = blocks.in_blocks(docs, doc_id, text, shape)

    def read(table: pa.Table) -> tuple:
        table = blocks.in_order(table)
        buffer, offsets = words.text_bytes(table["text"])
        runs = anchor_runs(buffer, offsets, length, gram)
        owners = blocks.doc_ids(table)[np.searchsorted(offsets, runs.first, side="right") - 1]
        return table, buffer, offsets, runs, owners, *blocks.distinct(runs.keys, owners)

    def ask_anchors(key: tuple, table: pa.Table) -> pa.Table:
        *_, keys, twice, _ = read(table)
        return blocks.packed(key[0].as_py(), blocks.shared_asks(keys, twice, shape.buckets))

    def candidates(table: pa.Table, replies: list) -> tuple:
        """The runs of shared anchors, and their distinct snippets in the order of their anchors."""
        table, buffer, offsets, runs, owners, keys, _, where = read(table)
        shared = blocks.shared_bits(keys, shape.buckets, replies)[where]
        runs, owners = Runs(*(x[shared] for x in runs)), owners[shared]
        return table, buffer, offsets, runs, owners, distinct_snippets(runs, owners)

    def ask_snippets(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, buffer, _, runs, _, found = candidates(table, blocks.replies(answers))
        starts = runs.first[found.example]
        sizes = runs.last[found.example] + length - starts
        rows = [
            (b, snippet_payload(buffer, found.keys[s], found.least[s], starts[s], sizes[s]))
            for b, s in blocks.by_bucket(found.keys, shape.buckets)
        ]
        return blocks.packed(key[0].as_py(), rows)

    def answer(payloads: list) -> list[bytes]:
        return earlier_strings([read_payload(p) for p in payloads], length)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        first = answers.filter(pa.compute.equal(answers["step"], 1)) if len(answers) else answers
        second = answers.filter(pa.compute.equal(answers["step"], 2)) if len(answers) else answers
        table, buffer, offsets, runs, owners, found = candidates(table, blocks.replies(first))
        masks = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r, np.uint32) for r in blocks.replies(second))])
        bits = masks[found.where] | np.where(found.least[found.where] < owners, np.uint32(0xFFFFFFFF), np.uint32(0))
        starts = np.zeros(len(buffer), dtype=bool)
        for t in range(length - gram + 1):
            at = runs.first + t
            starts[at[(at <= runs.last) & ((bits >> np.uint32(t)) & np.uint32(1)).astype(bool)]] = True
        gone = words.spread(np.flatnonzero(starts), length, len(buffer))
        sums = np.concatenate([[0], np.cumsum(gone)])
        lows, highs = words.runs_of(gone, offsets)
        texts_of = np.searchsorted(offsets, lows, side="right") - 1
        spans = pa.StructArray.from_arrays(
            [
                pa.array((lows - offsets[texts_of]).astype(np.int32)),
                pa.array((highs - offsets[texts_of]).astype(np.int32)),
            ],
            ["start", "end"],
        )
        cuts = np.searchsorted(texts_of, np.arange(len(table) + 1)).astype(np.int32)
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array(np.diff(offsets), pa.int64()),
                "n_removed": pa.array(np.diff(sums[offsets]), pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
                "kept": words.cut(buffer, offsets, ~gone),
            }
        )

    asked = texts.groupBy("block").applyInArrow(ask_anchors, blocks.ASK)
    anchored = blocks.answered(asked, blocks.shared_answer)
    snippets = texts.groupBy("block").cogroup(anchored.groupBy("block")).applyInArrow(ask_snippets, blocks.ASK)
    compared = blocks.answered(snippets, answer)
    both = anchored.withColumn("step", F.lit(1)).unionByName(compared.withColumn("step", F.lit(2)))
    return texts.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(remove, RESULT)


class Runs(NamedTuple):
    """Neighbouring strings with one anchor: first and last start, hash of the anchor, hash of the snippet."""

    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    content: np.ndarray


def anchor_runs(buffer: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> Runs:
    whole = np.zeros(len(buffer), dtype=bool)  # a string starts here and ends within its text
    sizes = np.diff(offsets)
    long = sizes >= length
    if long.any():
        whole = words.spread(offsets[:-1][long], sizes[long] - length + 1, len(buffer))
    found = []
    for low in range(0, len(buffer), words.SEGMENT):  # an anchor depends on its string alone, so any cut will do
        piece = words.BYTE_VALUES[buffer[low : low + words.SEGMENT + length - 1]]
        if len(piece) < length:
            break
        up, down = words.powers(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(piece * up[:-1], out=sums[1:])
        grams = (sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1]
        order = words.mix(grams) & np.uint64(0xFFFFFFFF00000000)
        order |= np.arange(len(order), dtype=np.uint64)
        anchor = (words.sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        valid = whole[low : low + len(anchor)]
        changed = np.ones(len(anchor) + 1, dtype=bool)
        changed[1:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:] | ~valid[:-1]
        first = np.flatnonzero(changed[:-1] & valid)
        last = np.flatnonzero(changed[1:] & valid)
        content = (sums[last + length] - sums[first]) * down[first]
        found.append((first + low, last + low, words.mix(grams[anchor[first]], 6), words.mix(content, 7)))
    if not found:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*found)))


class Snippets(NamedTuple):
    keys: np.ndarray  # hash of the anchor, ascending
    least: np.ndarray  # smallest doc_id of the block
    example: np.ndarray  # a run with this content
    where: np.ndarray  # the place of each run


def distinct_snippets(runs: Runs, owners: np.ndarray) -> Snippets:
    order = np.lexsort((runs.content, runs.keys))
    keys, content = runs.keys[order], runs.content[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (content[1:] != content[:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(owners[order], heads) if len(heads) else owners[:0]
    where = np.empty(len(order), dtype=np.int64)
    where[order] = np.cumsum(new) - 1
    return Snippets(keys[heads], least, order[heads], where)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def snippet_payload(buffer, keys, least, starts, sizes) -> bytes:
    width = 1 if int(sizes.max(initial=0)) < 256 else 4  # bytes of a size
    head = np.array([len(keys), width], np.int64).tobytes()
    parts = (least.astype(np.int64), keys.astype(np.uint32), sizes.astype(f"u{width}"), buffer[ranges(starts, sizes)])
    return head + b"".join(p.tobytes() for p in parts)


def read_payload(payload) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(payload, np.uint8)
    n, width = map(int, raw[:16].view(np.int64))
    least, keys, rest = raw[16 : 16 + 8 * n].view(np.int64), raw[16 + 8 * n :][: 4 * n].view(np.uint32), raw[16 + 12 * n :]
    return least, keys, rest[: width * n].view(f"u{width}"), rest[width * n :]


def earlier_strings(parts: list[tuple[np.ndarray, ...]], length: int) -> list[bytes]:
    """For each snippet a mask: bit t is set if an earlier document than its own holds the string at t.

    Equal snippets of many blocks enter the suffix arrays once, and not at all if their anchor has no other snippet: equal
    strings have one anchor.
    """
    least, keys, sizes, text = (np.concatenate(x) for x in zip(*parts))
    sizes = sizes.astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    heads, place = equal_snippets(keys, sizes, starts, text)
    owners = np.full(len(heads), blocks.NO_DOC)
    np.minimum.at(owners, place, least)
    strings = sizes - length + 1
    masks = np.where(owners[place] < least, (np.uint64(1) << strings.astype(np.uint64)) - np.uint64(1), np.uint64(0))
    masks = masks.astype(np.uint32)
    members = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[members], np.arange(len(heads) + 1))
    crowd = heads_in_company(keys[heads])
    for shard in shards(keys[heads[crowd]], sizes[heads[crowd]]):
        shard = crowd[shard]
        first = first_owners(shard, heads, starts, sizes, text, owners, length)
        copies = np.diff(bounds)[shard]
        mine = members[ranges(bounds[shard], copies)]
        for t in range(first.shape[1]):
            earlier = np.repeat(first[:, t], copies) < least[mine]
            masks[mine] |= earlier.astype(np.uint32) << np.uint32(t)
    return [m.tobytes() for m in np.split(masks, np.cumsum([len(p[0]) for p in parts])[:-1])]


def first_owners(shard, heads, starts, sizes, text, owners, length: int) -> np.ndarray:
    """Per distinct snippet of the shard and offset: the first document that holds the string there."""
    shape = sizes[heads[shard]]
    first = np.full((len(shard), int(shape.max()) - length + 1), blocks.NO_DOC)
    classes = []
    for piece in pieces(np.arange(len(shard)), shape):
        content = text[ranges(starts[heads[shard[piece]]], shape[piece])]
        classes.append((piece, *equal_strings(content, shape[piece], owners[shard[piece]], length)))
    if len(classes) > 1:
        classes = merged(classes)
    for piece, owner, offset, _, minimum in classes:
        first[piece[owner], offset] = minimum
    return first


def equal_snippets(keys: np.ndarray, sizes: np.ndarray, starts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An example of each distinct snippet, in the order of the keys, and the place of every snippet among them."""
    everything = np.arange(len(sizes))
    hashes = np.zeros(len(sizes), dtype=np.uint64)
    for piece in pieces(everything, sizes):
        ends = np.cumsum(sizes[piece])
        content = words.BYTE_VALUES[text[ranges(starts[piece], sizes[piece])]]
        hashes[piece] = words.run_hashes(content, ends - sizes[piece], ends)
    order = np.lexsort((sizes, hashes, keys))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (np.diff(keys[order]) != 0) | (np.diff(hashes[order]) != 0) | (np.diff(sizes[order]) != 0)
    head = np.maximum.accumulate(np.where(new, everything, 0))
    for piece in pieces(np.flatnonzero(~new), sizes[order]):  # by content: a chance hit of the hash stands alone
        mine, other = order[piece], order[head[piece]]
        shape = sizes[mine]
        same = text[ranges(starts[mine], shape)] == text[ranges(starts[other], shape)]
        new[piece] = ~np.logical_and.reduceat(same, np.cumsum(shape) - shape)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.searchsorted(np.flatnonzero(new), np.where(new, everything, head))
    return order[new], place


def heads_in_company(keys: np.ndarray) -> np.ndarray:
    """Places of the ascending keys that occur more than once."""
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


def shards(keys: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Snippets by ranges of the anchor's hash, so that equal strings share a shard."""
    count = 2 * int(sizes.sum()) // PIECE + 1
    owner = (keys.astype(np.uint64) * np.uint64(count)) >> np.uint64(32)
    order = np.argsort(owner, kind="stable")
    yield from (s for s in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(s))


def pieces(shard: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """A shard in parts that one suffix array can hold."""
    if not len(shard):
        return
    part = np.cumsum(sizes[shard]) // (PIECE - max(256, int(sizes[shard].max(initial=0))))
    yield from np.split(shard, np.flatnonzero(np.diff(part)) + 1)


def equal_strings(text: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Every string of the snippets: its snippet, its offset there, the string, the smallest owner of its class.

    Strings come in the order of the suffix array.
    """
    ends = np.cumsum(sizes)
    order = suffix_array(text, ends, sizes)
    prefix = common_prefixes(text, ends, sizes, order)
    snippet = np.repeat(np.arange(len(sizes)), sizes)[order]
    left = ends[snippet] - order
    whole = left >= length
    order, snippet = order[whole], snippet[whole]
    new = prefix[whole] < length
    new[:1] = True
    heads = np.flatnonzero(new)
    minimum = np.minimum.reduceat(least[snippet], heads) if len(heads) else least[:0]
    group = np.cumsum(new) - 1
    # bytes of the head of each class; a closing byte keeps trailing zeros
    columns = np.empty((len(heads), length + 1), dtype=np.uint8)
    columns[:, length] = 1
    for t in range(length):
        columns[:, t] = text[order[heads] + t]
    strings = columns.view(f"S{length + 1}").ravel()
    return snippet, order - (ends - sizes)[snippet], (strings, group, minimum), minimum[group]


def merged(classes: list[tuple]) -> list[tuple]:
    """Merge the sorted classes of the pieces of a shard by binary search, and hand the smallest owner back."""
    strings, minimum = classes[0][3][0], classes[0][3][2].copy()
    for *_, (more, _, least), _ in classes[1:]:
        at = np.searchsorted(strings, more)
        hit = np.zeros(len(more), dtype=bool)
        inside = at < len(strings)
        hit[inside] = strings[at[inside]] == more[inside]
        np.minimum.at(minimum, at[hit], least[hit])
        strings = np.insert(strings, at[~hit], more[~hit])
        minimum = np.insert(minimum, at[~hit], least[~hit])
    return [
        (piece, snippet, offset, own, minimum[np.searchsorted(strings, own[0])][own[1]])
        for piece, snippet, offset, own, _ in classes
    ]


def suffix_array(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, which end with their snippet; equal suffixes by position."""
    size = len(text)
    if not size:
        return np.zeros(0, np.int64)
    index = np.arange(size, dtype=np.uint64)
    left = np.repeat(ends, sizes) - np.arange(size)  # bytes to the end of the snippet
    present = np.zeros(256, dtype=np.uint64)
    present[np.unique(text)] = 1
    codes = np.cumsum(present)[text]  # dense, from 1; 0 is the end
    bits = int(codes.max()).bit_length()
    depth = min(8, (64 - INDEX_BITS) // bits)
    key = codes.copy()
    for t in range(1, depth):
        key <<= np.uint64(bits)
        key[: size - t] |= np.where(left[: size - t] > t, codes[t:], np.uint64(0))
    packed = np.sort((key << np.uint64(INDEX_BITS)) | index)
    low = np.uint64((1 << INDEX_BITS) - 1)
    order = (packed & low).astype(np.int64)
    packed >>= np.uint64(INDEX_BITS)
    rank, active = regrouped(order, packed, np.arange(size), np.zeros(size + 1, dtype=np.uint64))
    longest = int(sizes.max())
    while depth < longest and len(active):
        members = order[active]
        beyond = np.where(left[members] > depth, members + depth, size)  # rank[size] is 0: past the end
        key = (rank[members] << np.uint64(2 * INDEX_BITS)) | (rank[beyond] << np.uint64(INDEX_BITS))
        packed = np.sort(key | members.astype(np.uint64))
        members = (packed & low).astype(np.int64)
        order[active] = members
        rank, kept = regrouped(members, packed >> np.uint64(INDEX_BITS), active, rank)
        active = active[kept]
        depth *= 2
    return order


def regrouped(members: np.ndarray, keys: np.ndarray, places: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank each member by the first place of its group of equal keys; which members are still not alone."""
    new = np.ones(len(keys) + 1, dtype=bool)
    new[1:-1] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new[:-1])
    group = np.cumsum(new[:-1]) - 1
    rank[members] = (places[heads][group] + 1).astype(np.uint64)
    return rank, np.flatnonzero(~(new[:-1] & new[1:]))


def common_prefixes(text: np.ndarray, ends: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order: Kasai's walk, through all snippets side by side."""
    size = len(text)
    before = np.full(size, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    end = np.repeat(ends, sizes)
    out = np.zeros(size, dtype=np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, lengths = (ends - sizes)[by_size], sizes[by_size]
    carried = np.zeros(len(sizes), dtype=np.int64)
    for t in range(int(lengths[0]) if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -t, side="left"))  # snippets longer than t
        here = starts[:live] + t
        there = before[here]
        common = np.maximum(carried[:live] - 1, 0)
        common[there < 0] = 0
        limit = np.where(there < 0, 0, np.minimum(end[here] - here, end[there] - there))
        going = np.flatnonzero(common < limit)
        while len(going):
            same = text[here[going] + common[going]] == text[there[going] + common[going]]
            going = going[same]
            common[going] += 1
            going = going[common[going] < limit[going]]
        out[here] = common
        carried[:live] = common
    return out[order]
