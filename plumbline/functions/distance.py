"""How far apart two doubles are, in the units that mean something for floating point.

``bits`` reads a double's IEEE-754 pattern as a whole number: Arrow's buffer is viewed as 64-bit integers, so no value
becomes a Python object. All that follows from it is Columns. Null on either side gives null.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from plumbline.functions import ieee

EPSILON = 2.220446049250313e-16
#: What stands for the distance from a NaN: the largest unsigned 64-bit number.
NO_STEPS = 2**64 - 1


def _viewed(v: pa.Array) -> pa.Array:
    return v.view(pa.int64())


def bits(x: Column) -> Column:
    """The bit pattern as a signed number: rising with x from 0 up, falling with x below."""
    return F.arrow_udf(_viewed, LongType())(x.cast("double"))


def ordinal(x: Column) -> Column:
    """The bit pattern folded so that it rises with x over all numbers; both zeros are 0."""
    pattern = bits(x)
    return F.when(pattern < 0, F.lit(-(2**63)) - pattern).otherwise(pattern)


def ulps(a: Column, b: Column) -> Column:
    """Steps between two patterns, as decimal(20, 0): the wrapped difference's magnitude; NO_STEPS where one is NaN."""
    apart = F.abs(bits(a).cast("decimal(20,0)") - bits(b).cast("decimal(20,0)"))
    wrapped = F.least(apart, F.lit(Decimal(2**64)) - apart).cast("decimal(20,0)")
    steps = F.when(F.isnan(a) | F.isnan(b), F.lit(Decimal(NO_STEPS))).when(a == b, F.lit(0).cast("decimal(20,0)")).otherwise(wrapped)
    return F.when(a.isNotNull() & b.isNotNull(), steps)


def in_epsilons(a: Column, b: Column) -> Column:
    """The relative difference in units of rounding noise."""
    return ieee.relative(a, b) / EPSILON

