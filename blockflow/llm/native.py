"""Column expressions shared by the operators that use DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS

SPLIT = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value worked out once: a lambda's variable is never inlined by the optimiser."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none of a null."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SEPARATORS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPLIT)))


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def span(first: Column | int, last: Column) -> Column:
    """first..last, empty if last lies before first."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
