"""URL filters: a blocked Bloom filter of listed URLs in front of an exact join.

A rule is a host, a path and a verdict. It fits its host and all subdomains when the path of the URL starts with its own;
of the fitting rules the longest wins (then the longer host, then block before allow). A rule is listed under its host and its
path up to the last slash. A URL has one probe for each of its parent domains and each folder of its path, as far as the list has
domains of so many labels and folders of such depth. A probe is a hash, taken from sums over the bytes of host and path, so a URL with
thousands of folders costs its length. Probes that the filter does not know end there; for the rest the key is written out and
joined with the list, and the path of the rule is compared in full, so false positives cost a lookup and never a verdict. A URL that
no rule fits is allowed.

The filter has 256-bit blocks, 12 bits per listed key, and at most ``max_blocks`` blocks (32 MB): a longer list gets more
false positives, not a larger filter. Rules that share a folder but not a path share a key.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and the verdict allow. Rules with a null
host, path or verdict are passed over, repeated ones count once. Other columns are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import words

MAX_BLOCKS = 1 << 20
BITS_PER_KEY = 12
# odd multipliers below 2^31, one for each of the eight words of a block
SALTS = tuple(int(x) % (1 << 31) | 1 for x in words.mix(np.arange(8, dtype=np.uint64), 13))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def prefix_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each piece [start, end) of the bytes, from sums over all of them: no piece is copied."""
    return words.mix(words.run_hashes(words.BYTE_VALUES[buffer], starts, ends), salt)


def marked(buffer: np.ndarray, offsets: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place of such a byte, and the text it lies in."""
    at = np.flatnonzero(buffer == sign)
    owner = np.searchsorted(offsets, at, side="right") - 1
    return at, owner


class Probes(NamedTuple):
    """Keys of texts: a parent domain (from a byte of the host on) and a folder (up to a byte of the path)."""

    text: np.ndarray
    domain: np.ndarray
    folder: np.ndarray
    hashes: np.ndarray


def probes(hosts: tuple[np.ndarray, np.ndarray], paths: tuple[np.ndarray, np.ndarray], labels: int, depth: int) -> Probes:
    """Every parent domain of at most ``labels`` labels with every folder of at most ``depth`` slashes, the empty one included."""
    (host, host_at), (path, path_at) = hosts, paths
    count = len(host_at) - 1
    dot, owner = marked(host, host_at, 0x2E)
    behind = np.searchsorted(dot, host_at[owner + 1]) - np.arange(len(dot))  # labels after each dot
    few = behind <= labels
    whole = np.flatnonzero(np.bincount(owner, minlength=count) < labels)
    starts = np.concatenate([host_at[whole], dot[few] + 1])
    mine = np.concatenate([whole, owner[few]])
    by = np.lexsort((starts, mine))
    starts, mine = starts[by], mine[by]
    domain = prefix_hashes(host, starts, host_at[mine + 1], 14)

    slash, owner = marked(path, path_at, 0x2F)
    before = np.arange(len(slash)) - np.searchsorted(slash, path_at[owner])
    few = before < depth
    ends = np.concatenate([path_at[:-1], slash[few] + 1])
    theirs = np.concatenate([np.arange(count), owner[few]])
    by = np.lexsort((ends, theirs))
    ends, theirs = ends[by], theirs[by]
    folder = prefix_hashes(path, path_at[theirs], ends, 15)

    first = np.searchsorted(theirs, mine)
    number = np.searchsorted(theirs, mine, side="right") - first
    each = np.repeat(np.arange(len(mine)), number)
    at = np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first, number)
    return Probes(mine[each], starts[each], ends[at], words.mix(domain[each] + folder[at], 16))


def key_hashes(batches):
    """The hash of each rule's key, as the probes have it."""
    for batch in batches:
        hosts, paths = (words.text_bytes(batch.column(c)) for c in ("rule_host", "folder"))
        domain = prefix_hashes(hosts[0], hosts[1][:-1], hosts[1][1:], 14)
        folder = prefix_hashes(paths[0], paths[1][:-1], paths[1][1:], 15)
        yield pa.RecordBatch.from_arrays([pa.array(words.mix(domain + folder, 16).view(np.int64))], ["h"])


def filter_of(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The blocked Bloom filter of a column ``key``, for probes by xxhash64."""
    return filter_of_hashes(keys.select(F.xxhash64("key").alias("h")), max_blocks)


def filter_of_hashes(keys: DataFrame, max_blocks: int = MAX_BLOCKS) -> np.ndarray:
    """The blocked Bloom filter of a column ``h`` of hashes, as one row of eight 32-bit words per block."""
    blocks = min(max_blocks, keys.count() * BITS_PER_KEY // 256 + 1)
    words_of_key = [
        f"shiftleft(1L, cast(shiftrightunsigned(((h & 4294967295L) * {s}L) & 4294967295L, 27) as int))" for s in SALTS
    ]
    block = F.pmod(F.shiftrightunsigned("h", 32), F.lit(blocks))
    rows = keys.groupBy(block.alias("block")).agg(*(F.expr(f"bit_or({w}) as w{i}") for i, w in enumerate(words_of_key))).toArrow()
    table = np.zeros((blocks, 8), dtype=np.uint32)
    at = rows["block"].to_numpy()
    for i in range(8):
        table[at, i] = rows[f"w{i}"].to_numpy()
    return table


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    rows = table[((h >> np.uint64(32)) % np.uint64(len(table))).astype(np.int64)]
    low = h & np.uint64(0xFFFFFFFF)
    found = np.ones(len(h), dtype=bool)
    for i, salt in enumerate(SALTS):
        bit = ((low * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        found &= (rows[:, i] >> bit.astype(np.uint32)) & np.uint32(1) == 1
    return found


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, the rule that decides (host and path, or null) and the verdict."""
    listed = (
        rules.where("host is not null and path is not null and verdict is not null")
        .select(
            F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict")
        )
        .distinct()
        .withColumn("folder", F.regexp_extract("rule_path", "^(?s:.*)/", 0))
        .withColumn("key", F.concat("rule_host", F.lit("\n"), "folder"))
    )
    slashes = F.length("folder") - F.length(F.replace("folder", F.lit("/")))
    extent = listed.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("labels"), F.max(slashes).alias("depth")).first()
    labels, depth = extent["labels"] or 0, extent["depth"] or 0
    context = pages.sparkSession.sparkContext
    table = context.broadcast(filter_of_hashes(listed.select("rule_host", "folder").distinct().mapInArrow(key_hashes, "h long")))

    def possible(batches):
        for batch in batches:
            hosts, paths = (words.text_bytes(batch.column(c)) for c in ("host", "path"))
            for low, high in words.chunks(paths[1]):
                parts = [(data[at[low] : at[high]], at[low : high + 1] - at[low]) for data, at in (hosts, paths)]
                found = probes(*parts, labels, depth)
                hits = np.flatnonzero(contains(table.value, found.hashes))
                keys = [
                    bytes(parts[0][0][start : parts[0][1][t + 1]]) + b"\n" + bytes(parts[1][0][parts[1][1][t] : end])
                    for t, start, end in zip(found.text[hits], found.domain[hits], found.folder[hits])
                ]
                bounds = pa.array(np.searchsorted(found.text[hits], np.arange(high - low + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, pa.array(keys, pa.binary()))
                columns = [batch.column(c).slice(low, high - low) for c in ("page_id", "host", "path")]
                yield pa.RecordBatch.from_arrays([*columns, lists], ["page_id", "host", "path", "hits"])

    host, path = host_and_path(F.col(url).cast("string"))
    split = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    split = split.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    probed = words.in_small_batches(split).mapInArrow(possible, "page_id long, host string, path string, hits array<binary>")
    missed = probed.where(F.size("hits") == 0).select(
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")
    )
    hit = probed.where(F.size("hits") > 0)
    found = (
        hit.groupBy("host", "path")
        .agg(F.first("hits").alias("hits"))  # equal for equal host and path
        .select("host", "path", F.explode("hits").alias("key"))
        .withColumn("key", F.col("key").cast("string"))
        .join(listed, "key")
        .where(F.startswith("path", "rule_path"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("rule").alias("size"), F.length("rule_host"), (F.col("verdict") == "block"), "rule", "verdict"
                )
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.verdict")
    )
    judged = hit.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")
    )
    return missed.unionByName(judged)
