"""Predicates over text cells, and row fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabshift.functions.names import col

# Cell texts that a CSV scan reads as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Words that stand for a missing value inside a rendered text.
MISSING_WORDS = ("nan", "none", "null", "nat", "<na>")

_SEPARATOR = r"[\s\-_/,.]"
_REAL_WORD = (
    rf"(?iU)(?:^|{_SEPARATOR})(?!(?:{'|'.join(MISSING_WORDS)})(?:{_SEPARATOR}|$))[^\s\-_/,.]"
)
_NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_WHOLE = r"^\s*[+-]?\d+\s*$"
# digits of the widest decimal
_EXACT_DIGITS = 38


def na_to_null(cell: Column) -> Column:
    """Missing-value texts become null; exact and case-sensitive."""
    return F.when(cell.isin(*NA_TOKENS), F.lit(None)).otherwise(cell)


def is_populated(cell: Column) -> Column:
    """True when the text holds at least one word that is not a missing word."""
    return F.coalesce(cell.rlike(_REAL_WORD), F.lit(False))


def is_number(cell: Column) -> Column:
    return cell.rlike(_NUMBER)


def is_whole(cell: Column) -> Column:
    return cell.rlike(_WHOLE)


def to_whole(cell: Column) -> Column:
    """A whole number of any width up to 38 digits, exactly; null for other text."""
    return F.when(is_whole(cell), F.trim(cell).try_cast(f"decimal({_EXACT_DIGITS},0)"))


def to_double(cell: Column) -> Column:
    """Number of a text cell; null for null and for text that is no number."""
    return F.when(is_number(cell), F.trim(cell).try_cast("double"))


def fingerprint(values: list[Column]) -> list[Column]:
    """Two longs that are equal for equal value lists (null equal to null) and,
    with 128 bits, for no others. Shuffles 16 bytes instead of the values."""
    # xxhash64 skips nulls, so whether a value is null is hashed as well
    parts = [x for v in values for x in (v.isNull(), v)]
    return [F.xxhash64(F.lit(salt), *parts) for salt in (0, 1)]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
