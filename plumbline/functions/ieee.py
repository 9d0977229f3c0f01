"""IEEE-754 arithmetic as Column functions, where Spark's own differ: nothing here raises or turns NaN or infinity into null.

All inputs are doubles. The six event bits that an operation can raise are in :class:`Flag`.
"""

from __future__ import annotations

from enum import IntFlag

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


class Flag(IntFlag):
    NAN = 1
    INF = 2
    ZERO_DIVISION = 4
    INVALID_DOMAIN = 8
    INT_OVERFLOW = 16
    STEP_BUDGET = 32


def d(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def negative(x: Column) -> Column:
    """Whether the sign bit is set, also of -0.0; false for NaN."""
    return F.when(x == 0, x.cast("string").startswith("-")).otherwise(~F.isnan(x) & (x < 0))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def div(a: Column, b: Column) -> Column:
    at_zero = F.when((a == 0) | F.isnan(a), NAN).when(negative(a) != negative(b), -INF).otherwise(INF)
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def rem(a: Column, b: Column) -> Column:
    """The Euclidean remainder, never negative."""
    r = F.try_mod(a, b)
    return F.when(b == 0, NAN).otherwise(F.when(~F.isnan(r) & (r < 0), r + F.abs(b)).otherwise(r))


def fmin(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def fmax(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def _number(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def lt(a: Column, b: Column) -> Column:
    return _number(a, b) & (a < b)


def le(a: Column, b: Column) -> Column:
    return _number(a, b) & (a <= b)


def gt(a: Column, b: Column) -> Column:
    return lt(b, a)


def ge(a: Column, b: Column) -> Column:
    return le(b, a)


def eq(a: Column, b: Column) -> Column:
    return _number(a, b) & (a == b)


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def _logarithm(f, x: Column) -> Column:
    return F.when(F.isnan(x), NAN).when(x == 0, -INF).when(x < 0, NAN).otherwise(f(x))


def ln(x: Column) -> Column:
    return _logarithm(F.ln, x)


def log2(x: Column) -> Column:
    return _logarithm(F.log2, x)


def log10(x: Column) -> Column:
    return _logarithm(F.log10, x)


def _whole(f, x: Column) -> Column:
    """Spark's floor and ceil go through bigint; what is large is whole already, and zero keeps the sign."""
    small = is_finite(x) & (F.abs(x) < 4503599627370496.0)
    r = f(F.when(small, x).otherwise(F.lit(0.0))).cast("double")
    return F.when(~small, x).when((r == 0) & negative(x), F.lit(-0.0)).otherwise(r)


def floor(x: Column) -> Column:
    return _whole(F.floor, x)


def ceil(x: Column) -> Column:
    return _whole(F.ceil, x)


def trunc(x: Column) -> Column:
    return F.when(negative(x), ceil(x)).otherwise(floor(x))


def round_half_away(x: Column) -> Column:
    """Nearest whole number, halves away from zero."""
    return F.when(negative(x), ceil(x - F.lit(0.5))).otherwise(_half_up(x))


def _half_up(x: Column) -> Column:
    low = floor(x)
    return F.when(is_finite(x) & (x - low >= 0.5), low + 1).otherwise(low)


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(F.isnan(x), x).when(gt(lo, hi), x).otherwise(F.greatest(lo, F.least(hi, x)))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def approx(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """The rule form of equality: within tolerance times the larger of |b| and 1."""
    return le(F.abs(a - b), F.lit(tolerance) * fmax(F.abs(b), F.lit(1.0)))


def result_flags(values: Column) -> Column:
    """What an array of results raises; a null raises nothing."""
    nan = F.when(F.array_contains(values, F.lit(NAN)), F.lit(int(Flag.NAN))).otherwise(F.lit(0))
    inf = F.array_contains(values, F.lit(INF)) | F.array_contains(values, F.lit(-INF))
    return nan.bitwiseOR(F.when(inf, F.lit(int(Flag.INF))).otherwise(F.lit(0)))


def median_or_zero(x: Column) -> Column:
    return F.coalesce(F.median(x), F.lit(0.0))


def relative(a: Column, b: Column) -> Column:
    """Distance as a share of the larger magnitude; infinite when one side is not finite and they differ."""
    scale = F.greatest(F.abs(a), F.abs(b))
    return F.when(eq(a, b), F.lit(0.0)).when(~is_finite(a) | ~is_finite(b), INF).otherwise(F.try_divide(F.abs(a - b), scale))


def cancellation(a: Column, b: Column) -> Column:
    """Decimal digits lost in a - b."""
    s = a - b
    scale = F.greatest(F.abs(a), F.abs(b))
    lost = F.greatest(log10(F.try_divide(scale, F.abs(s))), F.lit(0.0))
    return F.when((s == 0) | ~is_finite(s) | (scale == 0), F.lit(0.0)).otherwise(lost)


def in_epsilons(rel: Column) -> Column:
    return rel / F.lit(2.220446049250313e-16)
