"""Seeded draws that depend only on (seed, tag, row), never on partitioning,
so a re-run, a retry after a lost executor and a different cluster size all
give the same table.

A digest has 32 hex digits. Chance tests compare eight of them as text with a
threshold, which needs no number parsing and serves four columns per digest.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_DIGITS = 8
SLOTS = 4
_SLOT_RANGE = 1 << (4 * SLOT_DIGITS)
_UNIFORM_DIGITS = 13


def digest(seed: int, tag: str, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|{tag}|"), row_id))


def _digits(hexes: Column, slot: int) -> Column:
    return F.substring(hexes, 1 + SLOT_DIGITS * slot, SLOT_DIGITS)


def chance_threshold(probability: float) -> str | None:
    """Eight hex digits below which a draw counts as hit; None means always."""
    limit = math.ceil(probability * _SLOT_RANGE)
    return None if limit >= _SLOT_RANGE else format(max(limit, 0), "08x")


def chance(hexes: Column, slot: int, probability: float) -> Column:
    """True with the given probability."""
    threshold = chance_threshold(probability)
    if threshold is None:
        return F.lit(True)
    return _digits(hexes, slot) < F.lit(threshold)


def pick(hexes: Column, slot: int, n: Column | int) -> Column:
    """Integer in 0 .. n-1."""
    number = F.conv(_digits(hexes, slot), 16, 10).cast("bigint")
    return F.pmod(number, n if isinstance(n, Column) else F.lit(n))


def uniform(hexes: Column) -> Column:
    """Double in [0, 1) with 52 random bits."""
    number = F.conv(F.substring(hexes, 1, _UNIFORM_DIGITS), 16, 10).cast("bigint")
    return number / F.lit(float(1 << 52))


_LIMB = 1 << 32


def wide_uniform(hexes: Column, n: int) -> Column:
    """Integer in 0 .. n-1 for n up to 10**38, as decimal(38,0): the high half of the product
    of all 128 random bits with n, in limbs of 32 bits, so that every step stays exact."""
    wide = "decimal(38,0)"
    drawn = [F.conv(F.substring(hexes, 25 - 8 * k, 8), 16, 10).cast(wide) for k in range(4)]
    factor = [n >> 32 * k & _LIMB - 1 for k in range(4)]

    def column(k: int) -> Column:
        terms = [drawn[i] * F.lit(factor[k - i]).cast(wide) for i in range(4) if 0 <= k - i < 4]
        return sum(terms[1:], terms[0]).cast(wide)

    carry = F.lit(0).cast("bigint")
    for k in range(4):
        carry = F.call_function("div", column(k) + carry.cast(wide), F.lit(_LIMB).cast(wide))
    high = column(6)
    for k in (5, 4):
        high = (high * F.lit(_LIMB).cast(wide)).cast(wide) + column(k)
    return (high + carry.cast(wide)).cast(wide)
