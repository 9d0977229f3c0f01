"""The widest bracket of a level set in each cell: its two points of opposite sides that lie farthest apart.

The farthest of a set from any point is a corner of its convex hull, so each cell and side is boiled down to hull corners:
first within batches where the points are, then over what the batches left, which is merged as often as it takes to be
few. Whether three points turn is told exactly, so points on an edge are no corners, however many a row or a line holds. The corners of the two sides of a cell are then held against each other. Exact for one and two axes.

Points are rows (id, u, level): u in unit coordinates, level negative on the failing side; null levels and coordinates are
no side. Of points at one place the least id counts; of equally wide brackets that with the least id on the failing side,
then on the other. Brackets of no more than ``least`` are none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.scratch import stash

#: Corners that a cell's side may have before they are merged once more, spread over tasks.
FEW = 256
#: A turn's rounding error is at most this share of its two products.
ROUNDING = 1e-15


def turn(ax: float, ay: float, bx: float, by: float, cx: float, cy: float) -> float:
    """Which way a, b, c turn: above 0 to the left, below to the right, 0 exactly where they lie on a line."""
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    if abs(left - right) > ROUNDING * (abs(left) + abs(right)):
        return left - right
    if (ax == bx == cx) or (ay == by == cy):
        return 0.0
    if not np.isfinite([ax, ay, bx, by, cx, cy]).all():
        return 1.0  # such a place has no hull; its points stay
    a, b, c, d, e, f = (Fraction(v) for v in (ax, ay, bx, by, cx, cy))
    sign = (c - a) * (f - b) - (d - b) * (e - a)
    return float((sign > 0) - (sign < 0))


def ends(at: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Which points are the first or last of those that share a coordinate: the others lie between two points."""
    order = np.lexsort([along, at])
    first = np.concatenate([[True], at[order][1:] != at[order][:-1]])
    kept = np.zeros(len(at), bool)
    kept[order] = first | np.concatenate([first[1:], [True]])
    return kept


def corners(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the points, sorted by (x, y) and all different, are corners of their hull: indices, rising."""
    if len(x) < 3:
        return np.arange(len(x))
    outer = np.flatnonzero(ends(x, y) & ends(y, x))
    px, py = x[outer].tolist(), y[outer].tolist()

    def chain(order: range) -> list[int]:
        kept: list[int] = []
        for i in order:
            while len(kept) > 1 and turn(px[kept[-2]], py[kept[-2]], px[kept[-1]], py[kept[-1]], px[i], py[i]) <= 0:
                kept.pop()
            kept.append(i)
        return kept

    return outer[np.unique(chain(range(len(px))) + chain(range(len(px) - 1, -1, -1)))]


def hulls(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (keys, id, u0, u1) of each batch that are corners of their keys' hull."""
    k = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            whose = f.groupby(k, sort=False, dropna=False).ngroup().to_numpy()
            x, y = f["u0"].to_numpy(float), f["u1"].to_numpy(float)
            order = np.lexsort([f["id"].to_numpy(), y, x, whose])
            whose, x, y = whose[order], x[order], y[order]
            other = np.r_[True, whose[1:] != whose[:-1]][: len(order)]
            first = np.flatnonzero(other | np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(order)])
            for at in np.split(first, np.flatnonzero(other[first])[1:]):
                yield f.iloc[order[at[corners(x[at], y[at])]]]

    return points.mapInPandas(run, points.schema)


def widest(points: DataFrame, cell: str = "cell", axes: int = 2, least: float = 0.0) -> DataFrame:
    """(cell, failing, holding, gap2): ids of each cell's widest bracket and its squared width; cells without one have no row."""
    if axes not in (1, 2):
        raise ValueError("hull corners are exact for one and two axes only")
    u = [F.get("u", F.lit(i)).cast("double") if i < axes else F.lit(0.0) for i in range(2)]
    known = points.select(cell, (F.col("level") < 0).alias("side"), "id", u[0].alias("u0"), u[1].alias("u1")).where("side is not null and id is not null and u0 is not null and u1 is not null and not isnan(u0) and not isnan(u1)")
    key = [cell, "side"]
    first = hulls(known, key).groupBy(*key, "u0", "u1").agg(F.min("id").alias("id")).select(*known.columns)
    left = stash(first, "corners")
    while True:
        biggest = left.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
        if biggest <= FEW:
            break
        # Each round halves what a hot side has at least, or finds that all of it are corners.
        spread = left.repartition(*key, F.pmod(F.xxhash64("u0"), F.lit(-(-biggest // FEW)))).sortWithinPartitions(*key, "u0", "u1")
        fewer = stash(hulls(spread, key), "corners")
        if fewer.count() == left.count():
            break
        left = fewer
    gap = (F.col("a.u0") - F.col("b.u0")) * (F.col("a.u0") - F.col("b.u0")) + (F.col("a.u1") - F.col("b.u1")) * (F.col("a.u1") - F.col("b.u1"))
    a, b = left.where("side").alias("a"), left.where("not side").alias("b")
    pairs = a.join(b, F.col(f"a.{cell}").eqNullSafe(F.col(f"b.{cell}"))).select(F.col(f"a.{cell}").alias(cell), F.col("a.id").alias("failing"), F.col("b.id").alias("holding"), gap.alias("gap2")).where(F.col("gap2") > least * least)
    best = pairs.groupBy(cell).agg(F.max_by(F.struct("failing", "holding", "gap2"), F.struct("gap2", (-F.col("failing")).alias("f"), (-F.col("holding")).alias("h"))).alias("w"))
    return best.select(cell, "w.*")
