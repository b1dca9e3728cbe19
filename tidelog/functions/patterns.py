"""Text search on a message column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPABLE = "%_\\"


def contains_ignore_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring."""
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def search_pattern(q: str) -> str:
    """The pattern ``%q%``, in which ``%``, ``_`` and ``\\`` of the user keep their meaning.

    A backslash before any other character stands for that character; Spark
    refuses such a sequence, so it is written without the backslash.
    """
    out = []
    chars = iter(f"%{q}%")
    for ch in chars:
        if ch == "\\":
            following = next(chars)
            out.append(ch + following if following in ESCAPABLE else following)
        else:
            out.append(ch)
    return "".join(out)


def matches_pattern(text: Column, q: str) -> Column:
    return text.ilike(search_pattern(q))
