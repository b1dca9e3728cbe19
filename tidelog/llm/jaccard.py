"""N-gram Jaccard join with prefix filters under several global orders of the shingles.

If two sets reach similarity t, then under any one order of all shingles their prefixes (the first
n - ceil(t n) + 1 shingles of a set of n) share a shingle. The join asks this under ``orders`` different orders at once and
verifies only pairs that pass all of them. Every order puts rare shingles first (by powers of two of
the number of documents) and differs in how it arranges equally rare ones. A shingle that one document holds alone
joins nothing: a set with at least a prefix of such shingles has no partner, and only shared shingles are listed and compared.

What is known of a set beyond its shingles travels with its postings, so that most pairs end in the list where they meet: the
place of the shingle in the prefix bounds what can be common from there on; 64 bits for the prefix of each further order tell that two
prefixes share nothing; and the parities of the shingles in ``PARITIES`` classes tell at least how many shingles only one of two sets
has. All three only bound, so no linked pair is lost. Sets are joined for what is left.

Equal texts are one node from the start. In a long list, such as that of a large group of near copies, comparing all pairs
would be quadratic. So first each node is compared with one pivot, the most central of the nodes that share its
prefixes, and components are formed. Then only pairs of different components are compared, and only those that could be similar
enough: by their numbers of shared shingles, and, if both were compared with one pivot, by what each shares with it.
That leaves no pair that could still join two components.

Defined results: null, empty and blank texts have no shingles and are linked with nothing. A text of fewer words than ``size``
has one shingle, all its words. Rows of equal text are linked whatever their doc_id; a null doc_id is never the
smallest of a component unless it has no other. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import blocks, words
from tidelog.session import shared_dir

SETS = "node binary, n long, shared long, tokens array<long>, prefixes array<array<long>>, parity array<long>, masks array<long>"
PARITIES = 256
MOST = 255


def shingles(found: words.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ordered by text and hash, and the text of each."""
    counts = found.counts()
    place = np.arange(len(found.starts)) - np.repeat(found.first[:-1], counts)
    whole = np.flatnonzero(place + size <= np.repeat(counts, counts))
    keys = [words.mix(words.gram_hashes(found.hashes, size)[whole], 20)]
    owner = [found.texts()[whole]]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        keys.append(words.mix(words.gram_hashes(found.hashes, n)[found.first[short]], 20 + n))
        owner.append(short)
    key, text = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], text[new]


def count_asks(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    low, few = keys.astype(np.uint32), np.minimum(counts, MOST).astype(np.uint8)
    return [(b, low[s].tobytes() + few[s].tobytes()) for b, s in blocks.by_bucket(keys, buckets)]


def count_answer(payloads: list) -> list[bytes]:
    """Per shingle 0 if one document holds it, else 1 + log2 of their number, rounded down."""
    sizes = [len(p) // 5 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes)])
    few = np.concatenate([np.frombuffer(p, np.uint8, n, offset=4 * n) for p, n in zip(payloads, sizes)])
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    totals = np.add.reduceat(few[order].astype(np.int64), np.flatnonzero(new))
    classes = np.where(totals == 1, 0, 1 + np.log2(totals).astype(np.int64)).astype(np.uint8)
    out = np.empty(len(keys), dtype=np.uint8)
    out[order] = classes[np.cumsum(new) - 1]
    return [o.tobytes() for o in np.split(out, np.cumsum(sizes)[:-1])]


def shingle_sets(
    docs: DataFrame, doc_id: str, text: str, size: int, percent: int, orders: int
) -> tuple[DataFrame, DataFrame]:
    """The distinct texts with their shared shingles and prefixes; and the text (node) of each row of the documents."""
    shape = blocks.layout(docs, text, 0.2)
    node = F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    texts = blocks.in_blocks(docs, doc_id, text, shape).withColumn(
        "node", F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    )
    members = docs.select(F.col(doc_id).cast("long").alias("doc_id"), node.alias("node"))
    chosen = members.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    chosen = chosen.select(blocks.block_of(F.col("doc_id"), F.col("node"), shape).alias("block"), "node")

    def read(table: pa.Table, nodes: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        wanted = set(nodes["node"].to_pylist()) if len(nodes) else set()
        rows = {}
        for i, name in enumerate(table["node"].to_pylist()):
            if name in wanted:
                rows.setdefault(name, i)
        names = sorted(rows)
        table = table.select(["text"]).take(pa.array([rows[x] for x in names], pa.int64()))
        found = words.words_of(*words.text_bytes(table["text"]), lower=True)
        return names, *shingles(found, size)

    def ask(key: tuple, table: pa.Table, nodes: pa.Table) -> pa.Table:
        _, keys, _ = read(table, nodes)
        unique, counts = np.unique(keys, return_counts=True)
        return blocks.packed(key[0].as_py(), count_asks(unique, counts, shape.buckets))

    def build(key: tuple, table: pa.Table, side: pa.Table) -> pa.Table:
        names, keys, owner = read(table, side.filter(pa.compute.is_valid(side["node"])) if len(side) else side)
        answers = side.filter(pa.compute.is_valid(side["payload"])) if len(side) else side
        unique = np.unique(keys)
        every = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(a, np.uint8) for a in blocks.replies(answers))])
        classes = every[np.searchsorted(unique, keys)]
        bounds = np.searchsorted(owner, np.arange(len(names) + 1))
        total = np.diff(bounds)
        alone = np.bincount(owner[classes == 0], minlength=len(names))
        prefix = total - (-(-percent * total // 100)) + 1 - alone  # listed shingles of each prefix
        open_ = (prefix > 0) & (total > alone)
        tokens, prefixes, parity, masks = [], [], [], []
        for i in range(len(names)):
            if not open_[i]:
                for column in (tokens, prefixes, parity, masks):
                    column.append(None)
                continue
            here = slice(bounds[i], bounds[i + 1])
            shared = classes[here] > 0
            own, rare = keys[here][shared], classes[here][shared]
            tokens.append(own.view(np.int64))
            heads = [own[np.lexsort((words.mix(own, 40 + o), rare))[: prefix[i]]] for o in range(orders)]
            prefixes.append([h.view(np.int64) for h in heads])
            odd = np.bincount((keys[here] % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
            parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            places = [np.unique(h >> np.uint64(58)) for h in heads[1:]]
            masks.append(np.array([np.bitwise_or.reduce(np.uint64(1) << p) for p in places], np.uint64).view(np.int64))
        return pa.table(
            {
                "node": pa.array(names, pa.binary()),
                "n": pa.array(total, pa.int64()),
                "shared": pa.array(total - alone, pa.int64()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "prefixes": pa.array(prefixes, pa.list_(pa.list_(pa.int64()))),
                "parity": pa.array(parity, pa.list_(pa.int64())),
                "masks": pa.array(masks, pa.list_(pa.int64())),
            }
        )

    asks = texts.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(ask, blocks.ASK)
    answers = blocks.answered(asks, count_answer)
    side = answers.withColumn("node", F.lit(None).cast("binary")).unionByName(chosen, allowMissingColumns=True)
    return texts.groupBy("block").cogroup(side.groupBy("block")).applyInArrow(build, SETS), members


def compared(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that share prefix shingles under every order, with their common shingles, and if they are linked."""

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "tokens", "prefixes"))
        )

    met = F.lit(True)
    for order in range(1, orders):  # the pairs come from the lists of order 0
        met = met & F.arrays_overlap(F.col("prefixes_a")[order], F.col("prefixes_b")[order])
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        pairs.join(side("b"), "b")
        .join(side("a"), "a")
        .where(met)
        .select(
            "a",
            "b",
            both.alias("common"),
            F.array_except("tokens_a", "tokens_b").alias("outside"),
            (F.col("n_a") + F.col("n_b")).alias("sum"),
        )
        .select("a", "b", "common", "outside", fits("common", "sum", F.lit(0), percent).alias("linked"))
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that edges reach, for every node that has one."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).checkpoint()
    while True:
        near = (
            both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        )
        lower = (
            labels.join(near, F.col("node") == F.col("a"))
            .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        )
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        stepped = (
            lower.join(jump, "label", "left")
            .select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
            .checkpoint()
        )
        labels = stepped.select("node", "label")
        if stepped.where(F.col("old") != F.col("label")).isEmpty():
            return labels


def fits(shared: str | Column, n: str | Column, other: str | Column, percent: int) -> Column:
    """Can ``shared`` common shingles make sets of n and ``other`` similar enough?"""
    shared, n, other = (F.col(x) if isinstance(x, str) else x for x in (shared, n, other))
    return (100 + percent) * shared >= percent * (n + other)


def linked(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, orders: int) -> DataFrame:
    """Per row: doc_id, node (its text), n_shingles, label (smallest node linked) and component_id."""
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    sets, members = shingle_sets(docs, doc_id, text, size, percent, orders)
    sets = sets.checkpoint()
    listed = sets.where("prefixes is not null")
    postings = listed.select("node", "n", "shared", F.explode(F.col("prefixes")[0]).alias("token"))

    pivots = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max(F.struct(F.col("shared") / F.col("n"), "n", F.col("node").alias("b"))).alias("pivot"),
    )
    starred = (
        postings.join(pivots.where("nodes > 1").select("token", "pivot.b"), "token")
        .where("node != b")
        .groupBy(F.col("node").alias("a"), "b")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("a")
        .agg(F.max(F.struct("times", "b")).alias("best"))
        .select("a", "best.b")
    )
    star = compared(starred, listed, percent, orders).checkpoint()
    links = star.where("linked").select("a", "b")
    labels = components(links)

    # What a node shares with the pivot it was compared with (inside) bounds what two nodes of one pivot share. Where the
    # inside alone is too small, the two must also share a shingle outside the pivot, and are found by those.
    kept = [F.col("parity")[i].alias(f"parity{i}") for i in range(PARITIES // 64)]
    kept += [F.col("masks")[i].alias(f"mask{i}") for i in range(orders - 1)]
    bits = [c for c in (f"parity{i}" for i in range(PARITIES // 64))] + [f"mask{i}" for i in range(orders - 1)]
    placed = (
        listed.select("node", "n", "shared", F.col("prefixes")[0].alias("prefix"), *kept)
        .join(labels, "node", "left")
        .join(star.select(F.col("a").alias("node"), "b", "common", "outside"), "node", "left")
        .select(
            "node",
            "n",
            "shared",
            "prefix",
            *bits,
            F.coalesce("label", "node").alias("label"),
            F.coalesce("b", "node").alias("pivot"),
            F.coalesce("common", "shared").alias("inside"),
            "outside",
        )
    ).checkpoint()
    columns = ("node", "n", "shared", "label", "pivot", "inside", *bits)
    apart = sum((F.bit_count(F.col(f"{b}_a").bitwiseXOR(F.col(f"{b}_b"))) for b in bits if b[0] == "p"), F.lit(0))
    alike = fits((F.col("n_a") + F.col("n_b") - apart) / 2, "n_a", "n_b", percent)
    for b in bits[PARITIES // 64 :]:
        alike = alike & (F.col(f"{b}_a").bitwiseAND(F.col(f"{b}_b")) != 0)

    def meeting(rows: DataFrame, keys: list[str], possible: Column) -> DataFrame:
        """Pairs of nodes of different components that meet in a list and could be linked."""

        def several(rows: DataFrame) -> DataFrame:
            """The rows of lists in which different components meet, with the least set size of the list."""
            lists = rows.groupBy(keys).agg(
                F.min("n").alias("least"), F.min("label").alias("low"), F.max("label").alias("high")
            )
            return rows.join(lists.where("low != high").select(*keys, "least"), keys)

        near = several(rows).where(fits("shared", "n", "least", percent)).drop("least")
        near = several(near).drop("least").checkpoint()
        names = [c for c in rows.columns if c not in keys]
        left, right = (near.select(*keys, *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
        return (
            left.join(right, keys)
            .where((F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & alike & possible)
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        )

    by_prefix = placed.select(*columns, F.posexplode("prefix").alias("at", "token"))
    inside = F.least("inside_a", "inside_b")
    # at the first shingle that two prefixes share, nothing before it is common
    onwards = F.least(F.col("shared_a") - F.col("at_a"), F.col("shared_b") - F.col("at_b"))
    most = F.when(F.col("pivot_a") == F.col("pivot_b"), F.least(inside, onwards)).otherwise(onwards)
    done = (F.col("pivot_a") == F.col("node_b")) | (F.col("pivot_b") == F.col("node_a"))  # compared already
    met = meeting(by_prefix, ["token"], ~done & fits(most, "n_a", "n_b", percent))
    by_outside = placed.select(*columns, F.explode("outside").alias("token"))
    beyond = F.least(F.col("shared_a") - F.col("inside_a"), F.col("shared_b") - F.col("inside_b"))
    met_outside = meeting(by_outside, ["pivot", "token"], fits(inside + beyond, "n_a", "n_b", percent))
    crossed = met.union(met_outside).distinct()
    rest = compared(crossed, listed, percent, orders).where("linked").select("a", "b")
    final = components(links.union(rest))
    named = (
        sets.join(final, "node", "left")
        .join(members.groupBy("node").agg(F.min("doc_id").alias("first_id")), "node")
        .withColumn("label", F.coalesce("label", "node"))
    )
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_node = named.select("node", "n", "label").join(smallest, "label").select("node", "n", "label", "component_id")
    return members.join(by_node, "node").select(
        "doc_id",
        "node",
        F.col("n").alias("n_shingles"),
        "label",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def join_components(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    orders: int = 3,
) -> DataFrame:
    """Per row: doc_id, number of shingles, smallest doc_id that links of at least ``percent`` similarity reach."""
    return linked(docs, doc_id, text, size, percent, orders).select("doc_id", "n_shingles", "component_id")


def one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    orders: int = 3,
) -> DataFrame:
    """One row of each group of linked documents, the one with the smallest doc_id, with all columns.

    Documents without words are linked with nothing, so all of them stay.
    """
    slot = F.coalesce(F.col("doc_id"), F.lit(blocks.NO_DOC)).alias("_slot")
    rows = linked(docs, doc_id, text, size, percent, orders).select(slot, F.col("node").alias("_node"), "n_shingles", "label")
    worded, blank = rows.where("n_shingles > 0"), rows.where("n_shingles = 0")
    first = worded.groupBy("label").agg(F.min(F.struct("_slot", "_node")).alias("first")).select("first.*")
    kept = first.withColumn("_single", F.lit(True)).unionByName(
        blank.select("_slot", "_node").distinct().withColumn("_single", F.lit(False))
    )
    named = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(blocks.NO_DOC)).alias("_slot"),
        F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("_node"),
    )
    turn = F.row_number().over(Window.partitionBy("_slot", "_node").orderBy(F.xxhash64("row")))
    return named.join(kept, ["_slot", "_node"]).withColumn("_turn", turn).where("_turn = 1 or not _single").select("row.*")
