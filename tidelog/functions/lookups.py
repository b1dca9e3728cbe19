"""Hashes of chosen attributes beside the rows, for scans that look for one value.

A VARIANT has no statistics that a scan could use. A table can keep a 64-bit hash of named attributes in columns of their
own, with dictionaries or Bloom filters in the Parquet files; equality on the hash then leaves out row groups without the
value. The hash only narrows the scan: values that differ in type or by chance may share one, so the
typed comparison of ``attributes`` still decides.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.attributes import NUMBER_TOKEN, field, plain_number


def column_name(key: str) -> str:
    """A column name without dots or quotes for any key."""
    return f"lookup_{hashlib.md5(key.encode()).hexdigest()[:16]}"


def stored_hash(doc: Column, key: str) -> Column:
    """The hash of a value as text, of a double as a number; null for other types and absent keys."""
    stored = field(doc, key)
    kind = F.schema_of_variant(stored)
    text = F.try_variant_get(stored, "$", "string")
    as_text = kind.isin("STRING", "BOOLEAN", "BIGINT") | kind.startswith("DECIMAL")
    number = F.try_variant_get(stored, "$", "double") + F.lit(0.0)  # -0.0 equals 0.0
    return F.when(as_text, F.xxhash64(text)).when(kind == "DOUBLE", F.xxhash64(number))


def could_equal(key: str, value: str) -> Column:
    """True for every row whose attribute equals the filter value in any type."""
    hashes = [F.xxhash64(F.lit(value))]
    if NUMBER_TOKEN.fullmatch(value):
        if plain_number(value) != value:
            hashes.append(F.xxhash64(F.lit(plain_number(value))))
        if math.isfinite(float(value)):
            hashes.append(F.xxhash64(F.lit(float(value) + 0.0)))
    return reduce(lambda a, b: a | b, [F.col(column_name(key)) == h for h in hashes])


def extended(schema: T.StructType, keys: Iterable[str]) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(column_name(k), T.LongType()) for k in keys])


def writer_options(columns: Iterable[str]) -> dict[str, str]:
    """Bloom filters for columns whose values do not fit a dictionary, sized by what a row group holds."""
    enabled = {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}
    return {**enabled, "parquet.bloom.filter.adaptive.enabled": "true"}
