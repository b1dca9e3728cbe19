"""Quality rules by host, in DataFrame operations only.

Every text is measured once (words, symbols, repeated lines, words in repeated 3-word windows). The failures of each rule are
summed by host. A host with few documents says little about itself, so its rates are shrunk towards the rate of all hosts by a
beta prior that is estimated from the hosts (moments of the beta-binomial): with an intra-host correlation c of the failures, a host with
n documents keeps the share n*c / (n*c + 1 - c) of its deviation. A host is refused where the shrunk rate of a rule exceeds
``max_rate``, and its verdict goes back to its documents.

Within a text nothing is exploded: windows are hashed (64 bits), sorted with their places and compared with their neighbours, in
n log n steps, and only if some window occurs twice at all. Intermediate arrays pass through a generator, since Spark
would otherwise evaluate them again inside each lambda. Documents are reduced to a few numbers before anything is shuffled, hosts are summed
partially before their exchange, and refused hosts are broadcast up to ``MOST_BROADCAST`` of them, beyond that joined
with salt, so that a host with a third of all rows spreads over tasks.

Defined results: null text is empty; a text without words fails the base rule. Bytes that are not UTF-8 count as U+FFFD.
The null host is a host of its own. Repeated rows are judged alike and all returned; a null doc_id is one like any other. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.session import shared_dir

BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 3
MOST_BROADCAST = 100_000
SALTS = 64

# Rules on a document. The first is the one that also refuses the document itself.
RULES: dict[str, Column | str] = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}


def held(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """The columns computed once per row: a generator, which Spark does not merge into later expressions."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]
    return rows.select(F.inline(F.array(F.struct(*named))))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    valid = F.make_valid_utf8(F.coalesce(F.col(text).cast("string"), F.lit("")))
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), valid.alias("t"))
    bare = F.btrim("t", F.lit(BLANKS))
    none = F.array().cast("array<string>")
    dealt = held(
        given,
        doc_id="doc_id",
        host="host",
        n_symbols=F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long"),
        lines=F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)) != ""),
        w=F.when(bare == "", none).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+", -1)),
    )
    at = F.sequence(F.lit(0), F.size("w") - WINDOW)
    word = lambda i: F.get(F.col("w"), i)
    grams = F.transform(at, lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))
    numbers = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    hashed = held(
        dealt,
        doc_id="doc_id",
        host="host",
        n_words=F.size("w").cast("long"),
        word_chars=F.char_length(F.array_join("w", "")).cast("long"),
        n_symbols="n_symbols",
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        grams=F.when(F.size("w") >= WINDOW, grams).otherwise(no_numbers()),
        bits=F.length(F.bin(F.size("w"))),
    )
    # Sorted as plain numbers first: the upper bits of the hash above the place. Windows alone in these bits are unique; the few
    # others are compared by their whole hashes.
    packed = F.transform("grams", lambda g, i: F.call_function("shiftleft", cut_off(g), F.col("bits")).bitwiseOR(i.cast("long")))
    some_again = F.size(F.array_distinct("grams")) < F.size("grams")
    rough = held(
        hashed,
        **{c: c for c in [*numbers, "grams", "bits"]},
        packed=F.when(some_again, F.sort_array(packed)).otherwise(no_numbers()),
    )
    place = lambda p: p.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    alike = beside_equal("packed", lambda p: cut_off(p), "bigint")
    whole = F.transform(alike, lambda p: F.struct(F.get("grams", place(p)).alias("g"), place(p).alias("i")))
    in_order = held(rough, **{c: c for c in numbers}, placed=F.array_sort(whole))
    repeated = beside_equal("placed", lambda p: p["g"], "struct<g:bigint,i:int>")
    places = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda seen, i: F.struct((seen["n"] + F.least(F.lit(WINDOW), i - seen["last"])).alias("n"), i.alias("last")),
        lambda seen: seen["n"],
    )
    count = F.when(F.size("placed") > 0, covered).otherwise(0).cast("long")
    return in_order.select(*numbers, count.alias("n_repeat_words"))


def no_numbers() -> Column:
    return F.array().cast("array<bigint>")


def cut_off(value: Column) -> Column:
    """The bits of a hash that are left above the place of its window."""
    return F.call_function("shiftright", value, F.col("bits"))


def beside_equal(items: str, key: Callable[[Column], Column], kind: str) -> Column:
    """Of a sorted array, the items that share their key with a neighbour."""
    nothing = F.array(F.lit(None).cast(kind))
    following = F.concat(F.slice(items, 2, F.greatest(F.size(items), F.lit(1))), nothing)
    preceding = F.slice(F.concat(nothing, F.col(items)), 1, F.size(items))
    equal = lambda a, b: F.coalesce(key(a) == key(b), F.lit(False))
    flags = F.zip_with(F.zip_with(items, following, equal), F.zip_with(items, preceding, equal), lambda a, b: a | b)
    return F.array_compact(F.zip_with(items, flags, lambda item, again: F.when(again, item)))


def host_rates(measured: DataFrame) -> DataFrame:
    """Per host: documents and, per rule, the documents that fail it."""
    fails = [F.count_if(F.expr(rule)).alias(name) for name, rule in RULES.items()]
    return measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *fails)


def correlations(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Per rule: the rate over all hosts, and the correlation of failures within a host; one row to the driver."""
    n = F.col("n").cast("double")
    first = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.sum(n).alias("rows"),
        F.sum(n * n).alias("squares"),
        *[F.sum(F.col(r).cast("double")).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_between") for r in RULES],
    ).first()
    out = {}
    for rule in RULES:
        if not first["rows"]:
            out[rule] = (0.0, 0.0)
            continue
        rate = first[rule] / first["rows"]
        within = rate * (1 - rate)
        between = first[f"{rule}_between"] - first["rows"] * rate * rate
        spare = first["hosts"] - 1
        scale = within * (first["rows"] - first["squares"] / first["rows"] - spare)
        out[rule] = (rate, min(1.0, max(0.0, (between - within * spare) / scale)) if scale > 0 else 0.0)
    return out


def shrunk(rule: str, rate: float, correlation: float) -> Column:
    """The posterior mean of the failure rate of a host."""
    held_back = F.col("n") * correlation / (F.col("n") * correlation + (1 - correlation))
    return F.lit(rate) + (F.col(rule) / F.col("n") - F.lit(rate)) * held_back


def judge_hosts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Per host: n, the shrunk rate of each rule, and whether the host is refused. ``measured`` is read twice."""
    hosts = host_rates(measured)
    known = correlations(hosts)
    rated = hosts.select("host", "n", *[shrunk(r, *known[r]).alias(r) for r in RULES])
    return rated.withColumn("refused", F.greatest(*RULES) > max_rate)


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    max_rate: float = 0.5,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Per document: the numbers of ``measure``, base_failed, host_refused, kept."""
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    measured = measure(docs, doc_id, text, host).checkpoint()  # the texts are read once
    refused = judge_hosts(measured, max_rate).where("refused").select(F.col("host").alias("_host"), F.lit(True).alias("_refused"))
    refused = refused.checkpoint()
    same = F.col("host").eqNullSafe(F.col("_host"))
    if refused.count() <= most_broadcast:
        joined = measured.join(F.broadcast(refused), same, "left").drop("_host")
    else:
        salted = measured.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        spread = refused.withColumn("_as", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, same & (F.col("_salt") == F.col("_as")), "left").drop("_host", "_salt", "_as")
    return (
        joined.withColumn("base_failed", F.expr(RULES["base"]))
        .withColumn("host_refused", F.coalesce("_refused", F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_refused"))
        .drop("_refused")
    )
