"""Joins of intervals and points by the nodes of a segment tree.

Whole numbers from 0 to 2^levels - 1 are the leaves of a tree. A closed interval is filed under the few nodes (two a level
at most) whose ranges make it up without overlap; a point asks for the nodes on its path to the root, one a level. Interval
and point meet in exactly one node where one holds the other, and nowhere else, so a range join is an equi-join on nodes.

Two intervals overlap where the later one starts inside the earlier one: each pair is found once, by the start of one of
them. Intervals whose ends are null or the wrong way round meet nothing. Rows that are alike stay as many as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scans import dealt
from plumbline.plans.scratch import stash

#: Deepest tree: ends are whole numbers of 64 bits.
DEEPEST = 62


def _node(level: Column, index: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), index.cast("long").alias("index"))


def nodes(lo: Column, hi: Column, levels: int) -> Column:
    """The nodes that make up [lo, hi], from the leaves up."""
    none = F.array().cast("array<struct<level:int,index:long>>")
    start = F.struct(lo.cast("long").alias("l"), (hi + 1).cast("long").alias("r"), none.alias("found"))

    def up(acc: Column, level: Column) -> Column:
        low, high = acc["l"], acc["r"]
        live = low < high
        odd_low, odd_high = live & (low % 2 == 1), live & (high % 2 == 1)
        mine = F.when(odd_low, F.array(_node(level, low))).otherwise(none)
        # Both ends may be odd and one apart: then the first alone is what is left.
        theirs = F.when(odd_high & (high - 1 >= F.when(odd_low, low + 1).otherwise(low)), F.array(_node(level, high - 1))).otherwise(none)
        next_low, next_high = F.when(odd_low, low + 1).otherwise(low), F.when(odd_high, high - 1).otherwise(high)
        return F.struct(F.shiftright(next_low, 1).alias("l"), F.shiftright(next_high, 1).alias("r"), F.concat(acc["found"], mine, theirs).alias("found"))

    made = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, up)["found"]
    return F.when((lo >= 0) & (hi >= lo), made).otherwise(none)


def path(at: Column, levels: int) -> Column:
    """The nodes from a leaf to the root."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda level: _node(level, F.call_function("shiftright", at.cast("long"), level)))


def levels_for(*ends: tuple[DataFrame, str]) -> tuple[int, int]:
    """(the least value, levels of a tree) that hold all of these columns."""
    found = [df.agg(F.min(c), F.max(c)).first() for df, c in ends]
    known = [v for r in found for v in r if v is not None]
    if not known:
        return 0, 0
    levels = (max(known) - min(known)).bit_length()
    if levels > DEEPEST:
        raise ValueError(f"ends are {levels} bits apart, more than {DEEPEST}")
    return min(known), levels


def stabbing(points: DataFrame, intervals: DataFrame, at: str, lo: str, hi: str, by: Sequence[str] = (), base: int = 0, levels: int = DEEPEST) -> DataFrame:
    """(point, interval), structs of both sides' columns, for every interval with lo <= at <= hi and equal keys.

    Values are at least base, and base + 2^levels is above them.
    """
    keys = [f"_b{i}" for i in range(len(by))]
    whole = lambda df, name: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
    own = lambda: [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    asked = points.where(F.col(at).isNotNull()).select(*own(), whole(points, "point"), F.explode(path(F.col(at) - base, levels)).alias("_node"))
    filed = intervals.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*own(), whole(intervals, "interval"), F.explode(nodes(F.col(lo) - base, F.col(hi) - base, levels)).alias("_node"))
    return asked.join(filed, [*keys, "_node"]).select("point", "interval")


def overlapping(a: DataFrame, b: DataFrame, lo: str = "lo", hi: str = "hi", by: Sequence[str] = ()) -> DataFrame:
    """(a, b), structs of both sides' columns, for every two closed intervals that overlap and have equal keys."""
    base, levels = levels_for((a, lo), (a, hi), (b, lo), (b, hi))
    right = lambda df: df.where(F.col(lo) <= F.col(hi))
    starts = stabbing(right(a), right(b), lo, lo, hi, by, base, levels).select(F.col("point").alias("a"), F.col("interval").alias("b"))
    later = stabbing(right(b), right(a), lo, lo, hi, by, base, levels).select(F.col("interval").alias("a"), F.col("point").alias("b"))
    return starts.unionByName(later.where(F.col(f"b.{lo}") > F.col(f"a.{lo}")))


def shared_length(a: Column, b: Column, lo: str = "lo", hi: str = "hi") -> Column:
    """How long two intervals overlap."""
    return F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo])


def overlap_totals(rows: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi", ranges: int | None = None) -> DataFrame:
    """For each closed interval how many overlap it, itself too, and how long in all: keys, met, shared; no pair is made.

    keys tell intervals apart; ends are whole numbers. Those that start by the end of an interval and do not end before its
    start overlap it. Up to a time t all have run for as long as starts and ends up to t tell, so what they run within an
    interval is the difference of two running sums. rows are read once.
    """
    end = lambda c, sign: F.struct(F.col(c).cast("long").alias("_t"), F.lit(sign).alias("_s"))
    ends = rows.where(F.col(lo) <= F.col(hi)).select(*keys, F.inline(F.array(end(lo, 1), end(hi, -1))))
    parts = stash(dealt(stash(ends, "ends"), ["_t"], ranges), "ends")
    # Sums of times pass 64 bits.
    t = F.col("_t").cast("decimal(20,0)")
    starts, stops, times = F.when(F.col("_s") > 0, 1).otherwise(0), F.when(F.col("_s") < 0, 1).otherwise(0), F.when(F.col("_s") > 0, t).otherwise(-t)
    along = Window.partitionBy("_part").orderBy("_t")
    upto, under = along.rangeBetween(Window.unboundedPreceding, 0), along.rangeBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({"_starts": F.sum(starts).over(upto), "_stops": F.sum(stops).over(upto), "_gone": F.coalesce(F.sum(stops).over(under), F.lit(0)), "_times": F.sum(times).over(upto)})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = parts.groupBy("_part").agg(F.sum(starts).alias("a"), F.sum(stops).alias("b"), F.sum(times).alias("c"))
    bases = sums.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("a", "b", "c")])
    met = own.join(F.broadcast(bases), "_part")
    live = F.col("_starts") + F.col("_a") - F.col("_stops") - F.col("_b")
    run = t * live.cast("decimal(18,0)") - (F.col("_times") + F.col("_c"))
    told = met.select(*keys, "_s", (F.col("_starts") + F.col("_a")).alias("begun"), (F.col("_gone") + F.col("_b")).alias("gone"), run.alias("run"))
    at = lambda sign, c: F.max(F.when(F.col("_s") == sign, F.col(c)))
    return told.groupBy(*keys).agg((at(-1, "begun") - at(1, "gone")).alias("met"), (at(-1, "run") - at(1, "run")).cast("long").alias("shared"))


def same(a: Sequence[str], left: str = "a", right: str = "b") -> Column:
    """Whether both sides of a pair have equal columns."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in a])
