"""Typed equality on dynamically keyed attributes.

A filter value arrives as text. It matches a stored string equal to it, a stored
boolean if it reads ``true``/``false``, and a stored number of the same value if
it is a plain decimal token. The stored type is always tested first: a cast alone
would let the string "3" pass for the number 3.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a number in a filter value.
NUMBER_TOKEN = re.compile(r"-?[0-9]+(\.[0-9]+)?")


def field(doc: Column, key: str) -> Column:
    """The VARIANT under a literal key: a dot or bracket is part of the key, never a path."""
    if key and "'" not in key:
        return F.try_variant_get(doc, f"$['{key}']", "variant")
    if key and '"' not in key:
        return F.try_variant_get(doc, f'$["{key}"]', "variant")
    return F.try_element_at(doc.try_cast("map<string,variant>"), F.lit(key))


def plain_number(token: str) -> str:
    """Decimal text without leading or trailing zeros, as Spark prints an exact VARIANT number."""
    number = Decimal(token)
    if number == 0:
        return "0"
    text = format(number, "f")
    sign, digits = ("-", text[1:]) if text.startswith("-") else ("", text)
    digits = digits.lstrip("0") or "0"
    if "." in digits:
        digits = digits.rstrip("0").rstrip(".")
    return sign + (("0" + digits) if digits.startswith(".") else digits)


def attr_equals(doc: Column, key: str, value: str) -> Column:
    stored = field(doc, key)
    kind = F.schema_of_variant(stored)
    text = F.try_variant_get(stored, "$", "string")
    match = (kind == "STRING") & (text == F.lit(value))
    if value in ("true", "false"):
        match = match | ((kind == "BOOLEAN") & (text == F.lit(value)))
    if NUMBER_TOKEN.fullmatch(value):
        exact = (kind == "BIGINT") | kind.startswith("DECIMAL")
        match = match | (exact & (text == F.lit(plain_number(value))))
        if math.isfinite(float(value)):
            approximate = F.try_variant_get(stored, "$", "double")
            match = match | ((kind == "DOUBLE") & (approximate == F.lit(float(value))))
    return F.coalesce(match, F.lit(False))


def attrs_match(doc: Column, attrs: Mapping[str, str], is_text: bool) -> Column:
    """All keys must match. JSON text is parsed once per row, whatever the number of keys."""

    def all_keys(parsed: Column) -> Column:
        return reduce(lambda a, b: a & b, [attr_equals(parsed, k, v) for k, v in attrs.items()])

    if not is_text:
        return all_keys(doc)
    return _may_match(doc, attrs) & F.exists(F.array(F.try_parse_json(doc)), all_keys)


def _may_match(text: Column, attrs: Mapping[str, str]) -> Column:
    """Spares parsing most rows that cannot match.

    Without a backslash nothing in the text is escaped, so the quoted key is found
    in it as it is, and so is a value that only a string can match.
    """
    needed = [f'"{key}"' for key in attrs]
    needed += [
        f'"{value}"'
        for value in attrs.values()
        if value not in ("true", "false") and not NUMBER_TOKEN.fullmatch(value)
    ]
    plain = reduce(lambda a, b: a & b, [F.contains(text, F.lit(part)) for part in needed])
    return F.contains(text, F.lit("\\")) | plain
