"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Sources share the words of the corpus by weight; no source gets more than ``most`` times its own words, and what a capped
source leaves is shared again among the others. Within a source a document is expected in proportion to its preference, at
most ``most`` times, so that the expected words of the source add up to its target. The preference is a column, or a function
of the size such as ``longer_first``; without one all are alike. It is rounded to sixteenths between 1/16 and 256; where it
is null, NaN or not above 0 the document is never taken.

The whole part of the expected number is taken for certain. For the rest p of it, the inclusion chance, documents are
ranked by their random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and taken in this order
while the words still fit what is left of the target; one closing document, the one that fits the remaining gap best,
completes the sample. So the sample has a fixed size in words, up to half of the closest document.

Running sums over a source would need its rows in one task. They are taken over bins of the rank instead, then over finer
bins within the bin in which the target falls, and so on to single rows (``refine``). Tables of one row per source are
broadcast after a count of rows and bytes; beyond it rows join them with a salt. Sources are ranked and their totals summed in
one task, which sees one short row per source.

Defined results: null text and texts without words have size 0; they take no part in the sampling and nothing of them is taken.
Null source is a source of its own, the last one. The random number depends on ``seed`` and doc_id, so reruns agree;
rows of one doc_id have equal odds for equal chances and are told apart by a hash of their place in the input. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import shared_dir

WEIGHTS = (5, 2, 1)
BINS = 4096
UNIT = 16  # preferences are whole sixteenths
MOST_LIKED = 256.0
SMALL_ROWS, SMALL_BYTES = 200_000, 16 << 20  # of a table that is broadcast
SALTS = 64

# Order of the rows of a source in steps: each step sums up the groups within the group that the step before has found.
STEPS = (("bin",), ("fine",), ("rank", "doc_id", "part"), ("tie", "row"))


def word_count(text: str) -> Column:
    """Number of runs without whitespace."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def uniform(doc_id: str, seed: int) -> Column:
    """A number between 0 and 1 from 52 bits of a digest of the seed and the doc_id."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sources(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Source, source_size and weight: weights in turn by code point of the source, null last."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, most: float) -> DataFrame:
    """Target words of each source.

    A source is capped when its share exceeds ``most`` times its words. Sources are capped in the order of words per
    weight: with the first k of that order capped, the rest share what these leave, so the final k is the first one
    at which the next source stays below its cap. One pass of running sums over the sources says the same as
    sharing again until no one is above.
    """
    ordered = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rated = sources.select(
        "*", (left / F.sum("weight").over(after)).alias("rate"), F.row_number().over(ordered).alias("place")
    ).withColumn("free", F.col("rate") * F.col("weight") <= most * F.col("source_size"))
    first_free = F.min(F.when(F.col("free"), F.struct("place", "rate"))).over(whole)
    return (
        rated.withColumn("first_free", first_free)
        .withColumn("capped", F.col("first_free").isNull() | (F.col("place") < F.col("first_free.place")))
        .select(
            "source",
            "source_size",
            F.when(F.col("capped"), most * F.col("source_size"))
            .otherwise(F.col("first_free.rate") * F.col("weight"))
            .cast("double")
            .alias("target"),
        )
    )


def longer_first(size: Column) -> Column:
    """A preference for longer documents: the fourth root of the size, cut to a power of two."""
    return F.pow(F.lit(2.0), (F.length(F.bin(size)) - 1) / F.lit(4.0))


def is_small(table: DataFrame) -> bool:
    """May a table with one row per source, or a few, be sent to every executor?"""
    row = table.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("source")).alias("bytes")).first()
    return row["rows"] <= SMALL_ROWS and (row["bytes"] or 0) <= SMALL_BYTES


def attach(rows: DataFrame, table: DataFrame, small: bool | None, *keys: str) -> DataFrame:
    """Add the columns of a table keyed by source (null is one as well) and further keys.

    A table that is not ``small`` is joined with a salt, or without where the rows are one per source as well (None).
    """
    keys = ("source", *keys)
    named = table.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    if small:
        return rows.join(F.broadcast(named), same, "left").drop(*[f"_{k}" for k in keys])
    if small is None:
        return rows.join(named, same, "left").drop(*[f"_{k}" for k in keys])
    spread = rows.withColumn("salt", F.pmod("row", F.lit(SALTS)))  # a hot source meets SALTS copies of its row
    copied = named.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = spread.join(copied, [*same, F.col("salt") == F.col("_salt")], "left")
    return joined.drop("salt", "_salt", *[f"_{k}" for k in keys])


def expectations(levels: DataFrame, most: float) -> DataFrame:
    """Expected copies of the documents of each source and preference (columns words, target).

    As for sources: the more preferred levels are capped first, and the first level below the cap fixes the rate of the rest.
    A source has at most 4096 levels.
    """
    liked_first = Window.partitionBy("source").orderBy(F.col("liking").desc())
    before = liked_first.rowsBetween(Window.unboundedPreceding, -1)
    after = liked_first.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    rated = levels.withColumn("rate", left / F.sum(F.col("words") * F.col("liking")).over(after)).withColumn(
        "free", F.col("rate") * F.col("liking") <= most * (1 - 1e-9)
    )
    first_free = F.max(F.when(F.col("free"), F.struct("liking", "rate"))).over(Window.partitionBy("source"))
    return rated.withColumn("first_free", first_free).select(
        "source",
        "liking",
        F.when(F.col("liking") <= F.col("first_free.liking"), F.col("first_free.rate") * F.col("liking"))
        .otherwise(float(most))
        .alias("expected"),
    )


def refine(rows: DataFrame, step: tuple[str, ...]) -> DataFrame:
    """Per source: the first group (columns of the step) at which the running sum of sizes exceeds ``left``, and the sum before.

    ``rows`` carry ``left`` and ``before``, the sum of all that precedes them. Sizes are added up per group first.
    """
    sums = rows.groupBy("source", *step).agg(
        F.sum("size").alias("words"), F.first("left").alias("left"), F.first("before").alias("before")
    )
    running = Window.partitionBy("source").orderBy(*step).rowsBetween(Window.unboundedPreceding, 0)
    upto = sums.withColumn("upto", F.col("before") + F.sum("words").over(running))
    over = F.col("upto") > F.col("left")
    return upto.groupBy("source").agg(
        F.min(F.when(over, F.struct(*step))).alias("last"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.first("before")).alias("before"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    most: int = 3,
    seed: int = 20,
    preference: str | Callable[[Column], Column] | None = None,
    bins: int = BINS,
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target of its source, copies in the mix, words taken."""
    shared_dir(docs.sparkSession)  # names the checkpoint folder of a local session
    counted = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        uniform(doc_id, seed).alias("u"),
        (F.col(preference) if isinstance(preference, str) else F.lit(1.0)).cast("double").alias("wish"),
        F.monotonically_increasing_id().alias("row"),
    )
    wish = preference(F.col("size")).cast("double") if callable(preference) else F.col("wish")
    liking = F.greatest(F.round(F.least(wish, F.lit(MOST_LIKED)) * UNIT).cast("long"), F.lit(1).cast("long"))
    sized = counted.select(
        "doc_id",
        "source",
        "size",
        "u",
        "row",
        F.when((F.col("size") > 0) & (wish > 0) & ~F.isnan(wish), liking).otherwise(0).alias("liking"),
    ).checkpoint()  # the texts are read once, and a row keeps its number
    sources = targets(weighted_sources(sized, weights), most).checkpoint()
    few_sources = is_small(sources)
    words = sized.where("liking > 0").groupBy("source", "liking").agg(F.sum("size").alias("words"))
    levels = words.withColumnRenamed("source", "_source").join(
        sources.select("source", "target"), F.col("_source").eqNullSafe(F.col("source"))
    )
    wanted = expectations(levels.drop("_source"), most).checkpoint()
    expected = attach(attach(sized, sources, few_sources), wanted, is_small(wanted), "liking")
    relative = F.col("rank") / (1 + F.col("rank"))
    planned = (
        expected.withColumn("expected", F.coalesce("expected", F.lit(0.0)))
        .withColumn("certain", F.floor("expected"))
        .withColumn("chance", F.col("expected") - F.col("certain"))
        .withColumn("eligible", (F.col("chance") > 0) & (F.col("certain") + 1 <= most))
        .withColumn(
            "rank",
            F.when(
                F.col("eligible"),
                (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))),
            ),
        )
        .withColumn("bin", F.floor(relative * bins))
        .withColumn("fine", F.floor(relative * bins * bins))
        .withColumn("tie", F.xxhash64("row"))
        .withColumn("part", F.shiftright("tie", 52))
    )
    # what is left of the target, and where the running sum of the ranked sizes passes it
    gap = (
        planned.groupBy("source")
        .agg((F.max("target") - F.sum(F.col("certain") * F.col("size"))).alias("left"))
        .withColumn("before", F.lit(0).cast("long"))
        .checkpoint()
    )
    narrow = planned.where("eligible").select("source", "size", *[c for step in STEPS for c in step])
    fits = attach(narrow, gap, few_sources)
    found = []
    for step in STEPS:
        limit = refine(fits, step).checkpoint()
        found.append(limit)
        group = attach(fits.drop("before"), limit, few_sources)
        fits = group.where(F.struct(*step) == F.col("last")).drop("last")
    edges = gap.drop("before")
    for i, limit in enumerate(found):
        edges = attach(edges, limit.withColumnsRenamed({"last": f"last_{i}", "before": f"before_{i}"}), None)
    done = F.coalesce(f"before_{len(STEPS) - 1}", "before_0", F.lit(0))
    edges = edges.select("source", *[f"last_{i}" for i in range(len(STEPS))], (F.col("left") - done).alias("gap")).checkpoint()
    order = [c for step in STEPS for c in step]
    edge = F.struct(*[F.col(f"last_{i}.{c}").alias(c) for i, step in enumerate(STEPS) for c in step])
    below = F.col("last_0").isNull() | (F.struct(*order) < edge)
    sampled = attach(planned, edges, few_sources).withColumn("sampled", F.col("eligible") & below)
    closing = (
        sampled.where(F.col("eligible") & ~F.col("sampled") & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "doc_id", "row")).alias("closing"))
        .select("source", F.col("closing.row").alias("closing_row"))
        .checkpoint()
    )
    chosen = F.col("sampled") | F.coalesce(F.col("row") == F.col("closing_row"), F.lit(False))
    copies = F.col("certain") + F.when(F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return (
        attach(sampled, closing, few_sources)
        .withColumn("copies", copies.cast("long"))
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
