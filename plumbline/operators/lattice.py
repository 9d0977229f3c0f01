"""Points of a lattice and the points next to them, by mixed-radix keys.

A point of a lattice with so many places on each axis has one number, its places as digits. Whoever looks for neighbours
sends its value to the numbers of the places around it (its halo), and the rest is an equi-join or, as here, a grouped
aggregate: each point is sent a few copies of what the points around it have, and no point is held against all others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(digits: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The mixed-radix number of places, first axis lowest."""
    out, place = F.lit(0).cast("long"), 1
    for d, size in zip(digits, sizes, strict=True):
        out, place = out + d.cast("long") * place, place * size
    return out


def halo(key: Column, sizes: Sequence[int]) -> Column:
    """The numbers of all places one step away, diagonals too, within the lattice."""
    digits = [F.call_function("div", key, F.lit(reduce(lambda a, b: a * b, sizes[:i], 1)).cast("long")) % size for i, size in enumerate(sizes)]
    near = []
    for step in product((-1, 0, 1), repeat=len(sizes)):
        if any(step):
            moved = [d + s for d, s in zip(digits, step, strict=True)]
            there = reduce(lambda a, b: a & b, [(m >= 0) & (m < size) for m, size in zip(moved, sizes, strict=True)])
            near.append(F.when(there, number(moved, sizes)))
    return F.filter(F.array(*near), lambda k: k.isNotNull())


def placed(points: DataFrame, lo: Sequence[float], step: Sequence[float], sizes: Sequence[int], key: str = "key") -> DataFrame:
    """points (with x) with the number of the lattice place nearest to them; those outside the lattice are left out."""
    digits = [F.round((F.get("x", F.lit(i)) - low) / s).cast("long") for i, (low, s) in enumerate(zip(lo, step, strict=True))]
    inside = reduce(lambda a, b: a & b, [(d >= 0) & (d < n) for d, n in zip(digits, sizes, strict=True)])
    return points.where(inside).withColumn(key, number(digits, sizes))


def layered(sites: DataFrame, sizes: Sequence[int], inside: str = "inside", violated: str = "violated", key: str = "key") -> DataFrame:
    """sites with what they say about a declared region: agrees, empty (inside, holds), boundary (violates outside, next to
    the inside) or stray (violates outside, farther away).

    Inside sites send word to their halo; a site that got some is next to the inside.
    """
    sent = sites.where(inside).select(F.explode(halo(F.col(key), sizes)).alias(key)).distinct().withColumn("_near", F.lit(True))
    met = sites.join(sent, key, "left")
    verdict = F.when(F.col(inside), F.when(F.col(violated), "agrees").otherwise("empty")).when(~F.col(violated), "agrees").when(F.col("_near"), "boundary").otherwise("stray")
    return met.select(*sites.columns, verdict.alias("verdict"))
