"""Element-wise arithmetic, comparison, minimum and maximum as plain Spark columns.

Everything stays within whole-stage code generation, and nothing depends on the
session's ANSI mode. Integers are 64-bit and wrap; a null integer propagates through
arithmetic and sorts below every other in comparisons; floats follow IEEE 754.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan() -> Column:
    return F.lit(float("nan"))


def wrapped(exact: Column) -> Column:
    """An exact decimal integer as 64 bits."""
    half, whole = (F.lit(str(n)).cast("decimal(20,0)") for n in (2**63, 2**64))
    return (F.pmod(exact + half, whole) - half).cast("bigint")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def add_i64(x: Column, y: Column) -> Column:
    """x + y mod 2^64, by halves that can't overflow: no branch, no decimals and no checked addition."""
    low = _low(x) + _low(y)
    high = F.shiftright(x, 32) + F.shiftright(y, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def subtract_i64(x: Column, y: Column) -> Column:
    low = _low(x) - _low(y)
    high = F.shiftright(x, 32) - F.shiftright(y, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(_low(low))


def multiply_i64(x: Column, y: Column) -> Column:
    return F.coalesce(F.try_multiply(x, y), wrapped((x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)")))


def to_f64(x: Column) -> Column:
    """An integer or float as a float; null is NaN."""
    return F.coalesce(x.cast("double"), _nan())


def divide(x: Column, y: Column) -> Column:
    """IEEE division of floats without nulls. The sign of a zero divisor is not looked at."""
    return F.when(y != 0, x / y).when((x == 0) | F.isnan(x), _nan()).otherwise(F.signum(x) * F.lit(float("inf")))


def equal_i64(x: Column, y: Column) -> Column:
    return x.eqNullSafe(y)


def less_i64(x: Column, y: Column) -> Column:
    return F.coalesce(x < y, x.isNull() & y.isNotNull())


def _ordered(x: Column, y: Column) -> Column:
    return ~F.isnan(x) & ~F.isnan(y)


def equal_f64(x: Column, y: Column) -> Column:
    return _ordered(x, y) & (x == y)


def less_f64(x: Column, y: Column) -> Column:
    return _ordered(x, y) & (x < y)


def min_i64(x: Column, y: Column) -> Column:
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("bigint")).otherwise(F.least(x, y))


def max_i64(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def min_f64(x: Column, y: Column) -> Column:
    return F.least(x, y)


def max_f64(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def identical_f64(x: Column, y: Column) -> Column:
    """Whether two floats have the same bits (NaN equals NaN, -0.0 differs from 0.0)."""
    return x.cast("string").eqNullSafe(y.cast("string"))


def is_zero(x: Column) -> Column:
    """The zero test behind not; null and NaN are no zeros."""
    return x.eqNullSafe(F.lit(0).cast("bigint"))


def floor_f64(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def square_root(x: Column) -> Column:
    return F.sqrt(to_f64(x))


def limbs(x: Column) -> tuple[Column, Column, Column]:
    """Three parts of an integer (high 16 bits with the sign, 24 bits, 24 bits) whose sums can't overflow below 2^39 rows."""
    return F.shiftright(x, 48), F.shiftright(x, 24).bitwiseAND(F.lit(0xFFFFFF)), x.bitwiseAND(F.lit(0xFFFFFF).cast("bigint"))


def joined(high: Column, middle: Column, low: Column) -> Column:
    """The wrapped integer of the sums of limbs; no rows sum to 0."""
    high, middle, low = (F.coalesce(c, F.lit(0).cast("bigint")) for c in (high, middle, low))
    return add_i64(add_i64(F.shiftleft(high, 48), F.shiftleft(middle, 24)), low)


def halves(x: Column) -> tuple[Column, Column]:
    """Two parts of an integer whose sums can't overflow below 2^31 rows."""
    return F.shiftright(x, 32), _low(x)


def joined_halves(high: Column, low: Column) -> Column:
    return F.shiftleft(high + F.shiftright(low, 32), 32).bitwiseOR(_low(low))


def sum_i64(x: Column, most: int | None = None) -> Column:
    """The wrapping sum; nulls are skipped and nothing sums to 0. One plain sum where `most`, a bound of the magnitude of any partial sum, is known to fit."""
    if most is not None and most < 2**63:
        return F.coalesce(F.sum(x), F.lit(0).cast("bigint"))
    return joined(*(F.sum(c) for c in limbs(x)))


def sum_f64(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0.0))
