"""As-of and nearest joins: each left row with the right row that is next to it on a scale, within equal keys.

Both sides are put into one order, (keys, scale), which is dealt by ranges of sampled splitters: each range is one external
sort, and in it a row looks back (or ahead) to the last right row before it. What a range's last right row is goes over to
the ranges behind, of which there is one row each. So neither a hot key nor the lack of keys makes one task of all rows,
and no left row meets more than one right row.

A left row whose scale or a key is null, and one with no right row in the direction, has a null match. Right rows with a
null scale or key match nothing. Of right rows with equal keys and scale the one with the largest ``tie`` counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranges import default_ranges, range_of, splitters
from plumbline.plans.scratch import stash

BACKWARD, FORWARD, NEAREST = "backward", "forward", "nearest"


def _sides(left: DataFrame, right: DataFrame, on: str, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Rows of both sides: _b0.. (keys), _on, _tag (0 right, 1 left), _row, _match."""
    keys = [f"_b{i}" for i in range(len(by))]
    put = lambda df: [*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(on).alias("_on")]
    blank = lambda df, name: F.lit(None).cast(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("s")).schema["s"].dataType).alias(name)
    whole = lambda df, name: F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)
    known = lambda df: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, on)]))
    rights = known(right).select(*put(right), whole(right, "_match"), F.struct(*[F.col(c) for c in tie]).alias("_tie") if tie else F.lit(0).alias("_tie"))
    rights = rights.groupBy(*keys, "_on").agg(F.max_by("_match", "_tie").alias("_match"))
    lefts = known(left).select(*put(left), F.lit(1).alias("_tag"), whole(left, "_row"), blank(right, "_match"))
    return lefts.unionByName(rights.select(*keys, "_on", F.lit(0).alias("_tag"), blank(left, "_row"), "_match"))


def join(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), tie: Sequence[str] = (), direction: str = BACKWARD, ranges: int | None = None) -> DataFrame:
    """left's columns and match, a struct of right's: the last right row with on <= the left's (backward), the first with a
    larger one (forward), or the nearer of the two (nearest; of equally near ones the earlier). on is a number on both sides."""
    if direction not in (BACKWARD, FORWARD, NEAREST):
        raise ValueError(f"no such direction: {direction}")
    keys = [*[f"_b{i}" for i in range(len(by))], "_on"]
    rows = stash(_sides(left, right, on, by, tie), "asof-sides")
    rows = rows.withColumn("_part", range_of(rows, keys, splitters(rows, keys, ranges or default_ranges(rows))))
    up = Window.partitionBy("_part").orderBy(*keys, "_tag")
    down = Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in (*keys, "_tag")])
    found = F.when(F.col("_match").isNotNull(), F.struct(*keys, "_match"))
    ways = {"_back": up} if direction == BACKWARD else {"_ahead": down} if direction == FORWARD else {"_back": up, "_ahead": down}
    seen = rows.select("*", *[F.last(found, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for name, w in ways.items()])
    seen = seen.select("*", *[F.lead(F.lit(1)).over(w).isNull().alias(f"{name}_end") for name, w in ways.items()])
    ends = reduce(lambda a, b: a | b, [F.col(f"{name}_end") for name in ways])
    seen = stash(seen.where((F.col("_tag") == 1) | ends).drop("_match"), "asof-seen")
    for name in ways:
        # One row a range: what the ranges before (or behind) it hand over.
        over = Window.orderBy("_part" if name == "_back" else F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = seen.where(f"{name}_end").select("_part", F.last(name, ignorenulls=True).over(over).alias(f"{name}_in"))
        seen = seen.join(F.broadcast(carried), "_part", "left").withColumn(name, F.coalesce(name, f"{name}_in"))
    same = lambda name: reduce(lambda a, b: a & b, [F.col(k) == F.col(f"{name}.{k}") for k in keys[:-1]], F.col(name).isNotNull())
    hits = {name: F.when(same(name), F.col(name)) for name in ways}
    if direction == NEAREST:
        back, ahead = hits["_back"], hits["_ahead"]
        nearer = ahead.isNull() | (F.col("_on") - back["_on"] <= ahead["_on"] - F.col("_on"))
        best = F.when(back.isNotNull() & nearer, back).otherwise(ahead)
    else:
        best = next(iter(hits.values()))
    out = seen.where("_tag = 1").select("_row.*", best["_match"].alias("match"))
    lost = left.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*by, on)]))
    return out.unionByName(lost.withColumn("match", F.lit(None).cast(out.schema["match"].dataType)))


def gap(match: Column | str, on: str) -> Column:
    """How far the match lies from its row; null without one."""
    return F.abs(F.col(on) - F.col(f"{match}.{on}"))
