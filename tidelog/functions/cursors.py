"""Opaque page cursors: base64url, without padding, of ``{"timestamp":…,"id":…}``, and of walks, which add ``"seen":…``."""

from __future__ import annotations

import base64
import binascii
import json
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.functions.times import iso_micros, utc

# Fixed value: an id inside a cursor, at most as long as the largest one.
ID_TEXT = re.compile(r"-?[0-9]{1,19}")
MAX_ID = 2**63 - 1

# Both ways of decoding read this grammar: base64url letters, an ISO 8601 time with a zone, years 1 to 9999 in UTC.
TOKEN = r"^[A-Za-z0-9_-]+={0,2}\z"
TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?"
    r"(Z|[+-](0[0-9]|1[0-7]):[0-5][0-9])\z"
)
FIRST, LAST = "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"


@dataclass(frozen=True)
class Cursor:
    timestamp: datetime
    id: int

    def encode(self) -> str:
        stamp = utc(self.timestamp).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        doc = json.dumps({"timestamp": stamp, "id": str(self.id)}, separators=(",", ":"))
        return base64.urlsafe_b64encode(doc.encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Cursor | None:
        """None for anything that is not a cursor."""
        doc = _document(token)
        if doc is None:
            return None
        stamp, row_id = doc.get("timestamp"), doc.get("id")
        if not isinstance(stamp, str) or not isinstance(row_id, str) or not ID_TEXT.fullmatch(row_id):
            return None
        if abs(int(row_id)) > MAX_ID:
            return None
        if not re.search(TIME.replace(r"\z", r"\Z"), stamp):
            return None
        try:
            return cls(utc(datetime.fromisoformat(stamp)), int(row_id))
        except (ValueError, OverflowError):  # no such day, or beyond the years
            return None


@dataclass(frozen=True)
class Walk:
    """A place in a walk over a table that goes on growing: the last row handed out, and per stream the last batch that the
    walk saw when it began."""

    cursor: Cursor
    seen: dict[str, int]

    def encode(self) -> str:
        doc = {**_document(self.cursor.encode()), "seen": self.seen}
        return base64.urlsafe_b64encode(json.dumps(doc, separators=(",", ":")).encode()).decode().rstrip("=")

    @classmethod
    def decode(cls, token: str) -> Walk | None:
        """None for anything that is not a place in a walk, plain cursors included."""
        cursor, doc = Cursor.decode(token), _document(token)
        seen = doc.get("seen") if cursor is not None else None
        if not isinstance(seen, dict) or not all(type(n) is int and n >= 0 for n in seen.values()):
            return None
        return cls(cursor, seen)


def _document(token: str) -> dict | None:
    if not re.search(TOKEN.replace(r"\z", r"\Z"), token):
        return None
    try:
        raw = base64.urlsafe_b64decode(token.rstrip("=") + "=" * (-len(token.rstrip("=")) % 4))
        doc = json.loads(raw.decode())
    except (binascii.Error, ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def cursor_token(ts: Column, row_id: Column) -> Column:
    doc = F.concat(
        F.lit('{"timestamp":"'), iso_micros(ts), F.lit('","id":"'), row_id.cast("string"), F.lit('"}')
    )
    # Spark wraps base64 text at 76 characters: drop the line breaks with the padding.
    return F.translate(F.base64(F.encode(doc, "UTF-8")), "+/=\r\n", "-_")


def cursor_fields(token: Column) -> Column:
    """Struct (timestamp, id), or NULL when the token is not a cursor. For whole columns of tokens."""
    letters = F.when(token.rlike(TOKEN), F.translate(token, "-_=", "+/"))
    padded = F.rpad(letters, (F.floor((F.length(letters) + 3) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    doc = F.try_parse_json(text)
    stamp, row_id = F.try_variant_get(doc, "$.timestamp", "variant"), F.try_variant_get(doc, "$.id", "variant")
    id_text = F.try_variant_get(row_id, "$", "string")
    parsed_ts = F.try_variant_get(stamp, "$", "string").try_cast("timestamp")
    parsed_id = id_text.try_cast("bigint")
    valid = (
        (F.schema_of_variant(stamp) == "STRING")
        & (F.schema_of_variant(row_id) == "STRING")
        & id_text.rlike(r"^-?[0-9]{1,19}\z")
        & F.try_variant_get(stamp, "$", "string").rlike(TIME)
        & parsed_ts.between(F.lit(FIRST).cast("timestamp"), F.lit(LAST).cast("timestamp"))
        & parsed_id.isNotNull()
    )
    return F.when(valid, F.struct(parsed_ts.alias("timestamp"), parsed_id.alias("id")))
