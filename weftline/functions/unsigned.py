"""Unsigned 64-bit meaning of LongType columns, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LIMB = 16
_MASK = (1 << _LIMB) - 1
_WORD = "18446744073709551616BD"


def u64_lt(c: Column, literal: int) -> Column:
    """c < literal; both conjuncts reach the Parquet scan. literal is below 2^63."""
    return (c >= 0) & (c < literal)


def u64_gt(c: Column, literal: int) -> Column:
    return (c > literal) | (c < 0)


def wrapping_sum(c: Column) -> Column:
    """SUM modulo 2^64 as a long with those bits; NULL over no rows.

    Four limbs of 16 bits are summed as longs, so partial sums stay in generated
    code and can't overflow below 2^46 rows (half a petabyte of values).
    """
    c = c.cast("long")
    carry, out = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(0, 64, _LIMB):
        limb = F.sum(F.shiftrightunsigned(c, k).bitwiseAND(F.lit(_MASK))) + carry
        carry = F.shiftrightunsigned(limb, _LIMB)
        out = out.bitwiseOR(F.shiftleft(limb.bitwiseAND(F.lit(_MASK)), k))
    return out


def wrapped(c: Column) -> Column:
    """A decimal modulo 2^64, as a long with those bits."""
    m = F.pmod(c.cast("decimal(38,0)"), F.expr(_WORD))
    return F.when(m >= F.expr("9223372036854775808BD"), m - F.expr(_WORD)).otherwise(m).cast("long")


def as_unsigned(c: Column) -> Column:
    """The unsigned value of a long's bits, as decimal(20,0)."""
    return (c.cast("decimal(20,0)") + F.when(c < 0, F.expr(_WORD)).otherwise(F.expr("0BD"))).cast("decimal(20,0)")
