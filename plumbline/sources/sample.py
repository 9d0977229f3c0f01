"""Generators of points: Halton sequences, reproducible uniform draws, grids, probe stars and swaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bases of the axes, in turn.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53)
GOLDEN = 0x9E3779B97F4A7C15
STEP = 1e-4


@dataclass(frozen=True)
class Axis:
    """A parameter's domain: an interval, or the values of a choice."""

    name: str
    lo: float = 0.0
    hi: float = 1.0
    choices: tuple[float, ...] = ()
    integer: bool = False

    @property
    def discrete(self) -> bool:
        return bool(self.choices)

    @property
    def width(self) -> float:
        return (max(self.choices) - min(self.choices)) if self.choices else self.hi - self.lo


def radical_inverse(index: Column, base: int) -> Column:
    """The digits of a non-negative index in some base, mirrored at the point."""
    digits = F.sequence(F.lit(1), F.lit(int(np.ceil(63 * np.log(2) / np.log(base)))))
    start = F.struct(index.cast("long").alias("left"), F.lit(0.0).alias("sum"), F.lit(1.0 / base).alias("place"))

    def add(acc: Column, _: Column) -> Column:
        digit = F.pmod(acc["left"], F.lit(base))
        return F.struct(F.floor((acc["left"] - digit) / base).cast("long").alias("left"), (acc["sum"] + digit * acc["place"]).alias("sum"), (acc["place"] / base).alias("place"))

    return F.aggregate(digits, start, add, lambda acc: acc["sum"])


def from_unit(u: Column, axis: Axis) -> Column:
    """A value of the axis for u in [0, 1]: along the interval, or the choice in whose slice u falls."""
    if axis.discrete:
        n = len(axis.choices)
        at = F.least(F.greatest(F.floor(u * n), F.lit(0)), F.lit(n - 1)).cast("int")
        return F.get(F.array(*map(F.lit, axis.choices)), at)
    value = F.lit(axis.lo) + F.lit(axis.hi - axis.lo) * u
    value = F.greatest(F.lit(axis.lo), F.least(F.lit(axis.hi), value))
    return value


def to_unit(v: Column, axis: Axis) -> Column:
    """The inverse: a choice gives the middle of its slice."""
    if axis.discrete:
        n = len(axis.choices)
        nearest = F.array_min(F.transform(F.array(*map(F.lit, axis.choices)), lambda c, i: F.struct(F.abs(c - v).alias("far"), i.alias("i"))))["i"]
        return (nearest + 0.5) / n
    return F.when(F.lit(axis.hi > axis.lo), (v - axis.lo) / F.lit((axis.hi - axis.lo) or 1.0)).otherwise(F.lit(0.0))


def halton(spark: SparkSession, n: int, axes: Sequence[Axis], first: int = 1) -> DataFrame:
    """(id, x): n points of the sequence from index first on."""
    points = spark.range(n).withColumnRenamed("id", "_i")
    u = [radical_inverse(F.col("_i") + first, PRIMES[i % len(PRIMES)]) for i in range(len(axes))]
    return points.select(F.col("_i").alias("id"), F.array(*[from_unit(v, a) for v, a in zip(u, axes, strict=True)]).alias("x"))


def label_seed(text: str) -> int:
    """The 64-bit FNV-1a hash of a label."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def draws(seed: int, index: np.ndarray) -> np.ndarray:
    """The index-th draws (from 1) in [0, 1) of a splitmix64 stream; each is computable by itself."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed ^ GOLDEN) + index.astype(np.uint64) * np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Stream:
    """The same draws one after the other."""

    def __init__(self, seed: int) -> None:
        self.seed, self.n, self.ahead = seed, 0, []

    def __call__(self) -> float:
        at = self.n % 256
        if at == 0:
            self.ahead = draws(self.seed, np.arange(self.n + 1, self.n + 257)).tolist()
        self.n += 1
        return self.ahead[at]


def uniform(spark: SparkSession, n: int, axes: Sequence[Axis], seed: int) -> DataFrame:
    """(id, x): n points, alike however they are partitioned."""
    k = len(axes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = f["id"].to_numpy()
            u = np.stack([draws(seed, at * k + i + 1) for i in range(k)], axis=1)
            yield pd.DataFrame({"id": at, "u": list(u)})

    u = spark.range(n).mapInPandas(run, "id long, u array<double>")
    return u.select("id", F.array(*[from_unit(F.get("u", F.lit(i)), a) for i, a in enumerate(axes)]).alias("x"))


def grid(spark: SparkSession, per_axis: int, axes: Sequence[Axis], midpoints: bool = False) -> DataFrame:
    """(id, x): all points of a lattice, ends included, or of the midpoints of per_axis slices."""
    points = spark.range(per_axis ** len(axes))

    def value(i: int, a: Axis) -> Column:
        digit = F.pmod(F.floor(F.col("id") / F.lit(per_axis**i)), F.lit(per_axis))
        u = (digit + 0.5) / per_axis if midpoints else digit / F.lit(max(per_axis - 1, 1))
        return from_unit(u.cast("double"), a)

    return points.select("id", F.array(*[value(i, a) for i, a in enumerate(axes)]).alias("x"))


def probe_star(points: DataFrame, axes: Sequence[Axis], step: float = STEP) -> DataFrame:
    """(base, axis, x): each point moved along each axis by step of its width, back only where the upper bound is nearer than that.

    On a choice it moves to the value before it, from the first to the second.
    """
    moved = []
    for i, a in enumerate(axes):
        v = F.get("x", F.lit(i))
        if a.discrete:
            values = F.array(*map(F.lit, a.choices))
            at = F.array_position(values, v) - 1
            to = F.get(values, F.when(at > 0, at - 1).otherwise(at + 1).cast("int"))
        else:
            by = step * (a.hi - a.lo)
            to = F.when((v - a.lo >= by) & (a.hi - v < by), v - by).otherwise(v + by)
        moved.append(F.struct(F.lit(i).alias("axis"), _with("x", i, to).alias("x")))
    return points.select(F.col("id").alias("base"), F.explode(F.array(*moved)).alias("p")).select("base", "p.axis", "p.x")


def _with(name: str, i: int, value: Column) -> Column:
    return F.transform(name, lambda w, j: F.when(j == i, value).otherwise(w))


def swapped(points: DataFrame, a: int, b: int) -> DataFrame:
    """(base, x): each point with two values exchanged."""
    return points.select(F.col("id").alias("base"), F.transform("x", lambda v, i: F.when(i == a, F.get("x", F.lit(b))).when(i == b, F.get("x", F.lit(a))).otherwise(v)).alias("x"))
