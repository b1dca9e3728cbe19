"""From request bodies to accepted rows, rejections and reports.

An envelope is one row ``(batch_key, body)`` with the JSON text ``{"logs": [...]}``.
All of this is projection and explode: no shuffle, whatever the size of a batch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import validation as V

# Envelope status.
OK = "ok"
REJECTED = "rejected"
REFUSED = "refused"


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows, with all columns computed at this point and only once.

    Spark moves a later filter below projections and repeats their expressions in
    it; here that would parse and judge every entry again. It does not move a
    filter below a generator.
    """
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def open_envelopes(envelopes: DataFrame, body_limit: int = V.MAX_BODY_BYTES) -> DataFrame:
    """Replace ``body`` by ``problem`` (why it is refused, NULL if readable) and ``logs`` (its entries)."""
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    # parse_json ignores text after the first value. Reading "[body, mark]" and
    # asking for exactly these two elements makes trailing text an error.
    mark = F.xxhash64("body")
    framed = F.concat(F.lit("["), F.col("body"), F.lit(","), mark.cast("string"), F.lit("]"))
    parsed = F.when(size <= body_limit, F.try_parse_json(framed))
    whole = (
        (F.try_variant_get("_parsed", "$[1]", "bigint") == mark)
        & F.try_variant_get("_parsed", "$[2]", "variant").isNull()
    )
    return (
        envelopes.withColumn("_parsed", parsed)
        .withColumn("logs", F.try_variant_get("_parsed", "$[0].logs", "array<variant>"))
        .withColumn(
            "problem",
            F.when(size > body_limit, V.BODY_TOO_LARGE)
            .when(size == 0, V.BODY_SHAPE)
            .when(~F.coalesce(whole, F.lit(False)), V.BODY_NOT_JSON)
            .when(F.col("logs").isNull(), V.BODY_SHAPE),
        )
        .withColumn("logs", F.when(F.col("problem").isNull(), F.col("logs")))
        .drop("_parsed", "body")
    )


def explode_entries(opened: DataFrame) -> DataFrame:
    """One row per entry with its 0-based ``index``; nothing for refused or empty envelopes.

    The outer form, because for the inner one Spark derives a filter on ``logs`` and
    pushes it down to the scan, where the body would be parsed once more.
    """
    exploded = opened.select("batch_key", F.posexplode_outer("logs").alias("index", "entry"))
    return exploded.filter(F.col("index").isNotNull())


def validate_entries(
    entries: DataFrame, now: datetime, max_service_len: int | None = None
) -> DataFrame:
    """Add ``reason`` and the typed log columns to rows with a VARIANT ``entry``."""
    carried = entries.columns
    # Each step is a projection of its own: a value used by several rules is computed once.
    as_struct = entries.withColumn("_entry", F.col("entry").try_cast(V.ENTRY_STRUCT))
    parts = {f"_{name}": column for name, column in vars(V.entry_fields(F.col("_entry"))).items()}
    extracted = as_struct.select(*carried, *[c.alias(name) for name, c in parts.items()])
    fields = V.EntryFields(**{name[1:]: F.col(name) for name in parts})
    validated = (
        extracted.withColumn("timestamp", V.parse_timestamp(fields))
        .withColumn("reason", V.reject_reason(fields, F.col("timestamp"), now, max_service_len))
        .select(
            *carried,
            "reason",
            "timestamp",
            fields.level.alias("level"),
            fields.service.alias("service"),
            fields.message.alias("message"),
            V.stored_attributes(fields).alias("attributes"),
        )
    )
    return _settled(validated)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reason").isNull()).drop("reason", "entry")


def rejected(validated: DataFrame, *keys: str) -> DataFrame:
    return validated.filter(F.col("reason").isNotNull()).select(*keys, "index", "reason")


def envelope_report(opened: DataFrame, now: datetime) -> DataFrame:
    """Per envelope: status, accepted count and the rejections in index order.

    Entries are judged inside their own row, so a report never gathers rows of
    different tasks, and its size is bound by the body limit.
    """

    names = list(V.EntryFields.__dataclass_fields__)

    # As in validate_entries, one step for each set of values that later rules share.
    def extract(entry: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in vars(V.entry_fields(entry)).items()])

    def with_time(part: Column) -> Column:
        fields = V.EntryFields(**{name: part[name] for name in names})
        return F.struct(part.alias("part"), V.parse_timestamp(fields).alias("parsed"))

    def judge(timed: Column, index: Column) -> Column:
        fields = V.EntryFields(**{name: timed["part"][name] for name in names})
        reason = V.reject_reason(fields, timed["parsed"], now)
        return F.struct(index.alias("index"), reason.alias("reason"))

    structs = F.transform("logs", lambda entry: entry.try_cast(V.ENTRY_STRUCT))
    judged = F.transform(F.transform(F.transform(structs, extract), with_time), judge)
    rejections = F.filter(judged, lambda r: r["reason"].isNotNull())
    report = (
        opened.select("batch_key", "problem", F.size("logs").alias("_entries"), rejections.alias("rejected"))
        .withColumn("rejected", F.coalesce("rejected", F.expr("array()")))
        .withColumn(
            "accepted",
            F.when(F.col("problem").isNull(), F.col("_entries") - F.size("rejected"))
            .otherwise(0)
            .cast("bigint"),
        )
        .select(
            "batch_key",
            F.when(F.col("problem").isNotNull(), REFUSED)
            .when(F.col("accepted") > 0, OK)
            .otherwise(REJECTED)
            .alias("status"),
            F.col("problem").alias("error"),
            "accepted",
            "rejected",
        )
    )
    return _settled(report)


def reason_counts(validated: DataFrame) -> DataFrame:
    return (
        validated.filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )
