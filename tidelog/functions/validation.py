"""Entry validation: one ordered CASE, first failing rule wins."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.times import ts_literal, utc

# The levels, the accepted lead of a timestamp, the largest body.
LEVELS = ("debug", "info", "warn", "error")
MAX_FUTURE = timedelta(minutes=5)
MAX_BODY_BYTES = 2 * 1024 * 1024

# Reasons for a rejected entry, in rule order.
BAD_TIMESTAMP = "timestamp must be a valid ISO 8601 string"
BAD_DATE = "timestamp is not a parseable date"
IN_FUTURE = "timestamp must not be more than 5 minutes in the future"
BAD_LEVEL = "level must be one of: debug, info, warn, error"
BAD_SERVICE = "service must be a non-empty string"
BAD_MESSAGE = "message must be a non-empty string"
BAD_ATTRIBUTES = "attributes must be a flat object"
BAD_ATTRIBUTE_VALUE = (
    "attributes values must be strings, numbers, or booleans (no nested objects or arrays)"
)
SERVICE_TOO_LONG = "service must be at most {limit} characters"

# Reasons for a refused body.
BODY_TOO_LARGE = "request body too large"
BODY_NOT_JSON = "malformed JSON body"
BODY_SHAPE = 'Request body must be { "logs": [...] }'

# Fixed patterns: date-time with a mandatory zone; the 24-character UTC form by punctuation only.
ISO_8601 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
UTC_MILLIS_SHAPE = r"(?s)^.{4}-.{2}-.{2}T.{2}:.{2}:.{2}\..{3}Z\z"

# The first instant that dates of the stored days can express: 0001-01-01T00:00:00Z.
_FIRST_MICROS = -62_135_596_800_000_000

# Midnight written as the end of a day.
_END_OF_DAY = r"T24:00:00(\.0+)?[Z+-]"

# One pass over the fields of an entry. Not being an object gives NULL.
ENTRY_STRUCT = (
    "struct<timestamp:string,level:string,service:variant,message:variant,attributes:variant>"
)


@dataclass(frozen=True)
class EntryFields:
    """Parts of an entry that the rules look at.

    ``timestamp_text`` and ``level`` need no type test: no other JSON value prints
    like an ISO time or a level. ``*_type`` is the JSON type, NULL when absent, and
    ``attribute_map`` is NULL unless the attributes are an object.
    """

    timestamp_text: Column
    is_iso: Column
    level: Column
    service: Column
    service_type: Column
    message: Column
    message_type: Column
    attributes: Column
    attribute_map: Column


def entry_fields(entry: Column) -> EntryFields:
    """Fields of an entry that was cast to ENTRY_STRUCT."""

    def text(name: str) -> Column:
        return F.try_variant_get(entry[name], "$", "string")

    return EntryFields(
        timestamp_text=entry["timestamp"],
        is_iso=F.coalesce(entry["timestamp"].rlike(ISO_8601), F.lit(False)),
        level=entry["level"],
        service=text("service"),
        service_type=F.schema_of_variant(entry["service"]),
        message=text("message"),
        message_type=F.schema_of_variant(entry["message"]),
        attributes=entry["attributes"],
        attribute_map=entry["attributes"].try_cast("map<string,variant>"),
    )


def parse_timestamp(fields: EntryFields) -> Column:
    """Instant of an ISO 8601 text with a zone, to the microsecond; NULL for an impossible date or one before year 1."""
    text = fields.timestamp_text
    next_day = F.regexp_replace(text, "T24:", "T00:").try_cast("timestamp") + F.expr("INTERVAL 1 DAY")
    plain = text.try_cast("timestamp")
    ends_day = (F.substring(text, 11, 3) == "T24") & text.rlike(_END_OF_DAY)
    instant = F.when(ends_day, next_day).otherwise(plain)
    return F.when(fields.is_iso & (instant >= F.timestamp_micros(F.lit(_FIRST_MICROS))), instant)


def _is_filled_text(kind: Column, value: Column) -> Column:
    return F.coalesce((kind == "STRING") & (value != ""), F.lit(False))


def _has_bad_value(attribute_map: Column) -> Column:
    def bad(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        return kind.startswith("OBJECT") | kind.startswith("ARRAY") | (kind == "VOID")

    return F.exists(F.map_values(attribute_map), bad)


def reject_reason(
    fields: EntryFields, parsed: Column, now: datetime, max_service_len: int | None = None
) -> Column:
    """Reason text of the first failing rule; NULL means accepted.

    ``now`` belongs to the whole batch and is compared at millisecond precision.
    """
    ceiling = utc(now + MAX_FUTURE)
    # Later by at least one whole millisecond, as the time to the millisecond is compared.
    too_late = ceiling.replace(microsecond=ceiling.microsecond // 1000 * 1000) + timedelta(milliseconds=1)
    has_shape = fields.is_iso | F.coalesce(fields.timestamp_text.rlike(UTC_MILLIS_SHAPE), F.lit(False))
    is_object = fields.attribute_map.isNotNull()
    has_attributes = fields.attributes.isNotNull() & ~F.is_variant_null(fields.attributes)
    rule = (
        F.when(~has_shape, BAD_TIMESTAMP)
        .when(parsed.isNull(), BAD_DATE)
        .when(parsed >= ts_literal(too_late), IN_FUTURE)
        .when(~F.coalesce(fields.level.isin(*LEVELS), F.lit(False)), BAD_LEVEL)
        .when(~_is_filled_text(fields.service_type, fields.service), BAD_SERVICE)
    )
    if max_service_len is not None:
        rule = rule.when(
            F.length(fields.service) > max_service_len, SERVICE_TOO_LONG.format(limit=max_service_len)
        )
    return (
        rule.when(~_is_filled_text(fields.message_type, fields.message), BAD_MESSAGE)
        .when(has_attributes & ~is_object, BAD_ATTRIBUTES)
        .when(is_object & _has_bad_value(fields.attribute_map), BAD_ATTRIBUTE_VALUE)
    )


def stored_attributes(fields: EntryFields) -> Column:
    """Absent and null attributes are stored as an empty object."""
    return F.when(fields.attribute_map.isNotNull(), fields.attributes).otherwise(
        F.parse_json(F.lit("{}"))
    )
