"""Ground truth as boxes, and what cells, findings and bands say about them.

Regions are rows (entry?, region, lo, hi), one box each, with ``keys`` (such as entry) telling corpora apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ieee

LOCALISED = 0.5
MAX_ATOMS = 1 << 20
#: Regions in a list that a point is held against.
MAX_LIST = 4096


def shared_volume(alo: str, ahi: str, blo: str, bhi: str) -> Column:
    """The volume of two boxes' intersection."""
    sides = F.arrays_zip(F.col(alo).alias("al"), F.col(ahi).alias("ah"), F.col(blo).alias("bl"), F.col(bhi).alias("bh"))
    return F.aggregate(F.transform(sides, lambda v: F.greatest(F.least(v["ah"], v["bh"]) - F.greatest(v["al"], v["bl"]), F.lit(0.0))), F.lit(1.0), lambda acc, w: acc * w)


def volume(lo: str = "lo", hi: str = "hi") -> Column:
    return F.aggregate(F.transform(F.arrays_zip(F.col(lo).alias("l"), F.col(hi).alias("h")), lambda v: v["h"] - v["l"]), F.lit(1.0), lambda acc, w: acc * w)


def overlaps(cells: DataFrame, regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells and regions that touch: keys, cell, region, label and overlap, the share of the cell inside the region."""
    k = list(keys)
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in k], "region", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    on = F.forall(F.arrays_zip(F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("rlo").alias("rl"), F.col("rhi").alias("rh")), lambda v: (v["h"] >= v["rl"]) & (v["l"] <= v["rh"]))
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = cells.join(r, on)
    share = F.when(volume() > 0, F.try_divide(shared_volume("lo", "hi", "rlo", "rhi"), volume())).otherwise(F.lit(0.0))
    return met.select(*k, "cell", "region", "label", volume().alias("volume"), share.alias("overlap"))


def detected(regions: DataFrame, cells: DataFrame, keys: Sequence[str] = (), least: float = 0.0) -> DataFrame:
    """Regions that a suspicious leaf touches (with least = LOCALISED: overlaps so far): a semi join."""
    hit = overlaps(cells.where("label = 'SUSPICIOUS'"), regions, keys).where(F.col("overlap") >= least)
    return regions.join(hit, [*keys, "region"], "left_semi")


def union_overlap(cells: DataFrame, regions: DataFrame, keys: Sequence[str] = (), axes: int = 1) -> DataFrame:
    """The exact share of each cell inside the union of the regions: keys, cell, overlap.

    Coordinates are compressed: the bounds of the regions that meet a cell cut it into atoms, of which each is inside
    or outside. A cell with more than MAX_ATOMS of them is refused: null.
    """
    k = list(keys)
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    on = F.forall(F.arrays_zip(F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("rlo").alias("rl"), F.col("rhi").alias("rh")), lambda v: (v["h"] > v["rl"]) & (v["l"] < v["rh"]))
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = cells.join(r, on).groupBy(*k, "cell", "lo", "hi").agg(F.collect_list(F.struct("rlo", "rhi")).alias("boxes"))
    cuts = []
    for i in range(axes):
        lo, hi = F.get("lo", F.lit(i)), F.get("hi", F.lit(i))
        cuts.append(_cuts(i, lo, hi).alias(f"cut{i}"))
    met = met.select(*k, "cell", "lo", "hi", "boxes", *cuts)
    atoms = F.lit(1)
    for i in range(axes):
        atoms = atoms * (F.size(f"cut{i}") - 1)
    met = met.withColumn("atoms", atoms)
    rows = met.where(F.col("atoms") <= MAX_ATOMS)
    for i in range(axes):
        rows = rows.withColumn(f"at{i}", F.explode(_pieces(f"cut{i}")))
    within = F.exists("boxes", lambda b: _all([(F.get(b["rlo"], F.lit(i)) <= F.col(f"at{i}.l")) & (F.get(b["rhi"], F.lit(i)) >= F.col(f"at{i}.h")) for i in range(axes)]))
    size = F.lit(1.0)
    for i in range(axes):
        size = size * (F.col(f"at{i}.h") - F.col(f"at{i}.l"))
    sums = rows.where(within).groupBy(*k, "cell").agg(F.sum(size).alias("covered"))
    refused = met.where(F.col("atoms") > MAX_ATOMS).select(*k, "cell", F.lit(True).alias("refused"))
    out = cells.join(sums, [*k, "cell"], "left").join(refused, [*k, "cell"], "left")
    share = F.try_divide(F.coalesce("covered", F.lit(0.0)), volume())
    return out.select(*k, "cell", F.when(F.col("refused").isNull(), share).alias("overlap"))


def sampled_overlap(cells: DataFrame, regions: DataFrame, keys: Sequence[str] = (), axes: int = 1, per_axis: int = 32) -> DataFrame:
    """The share of the midpoints of per_axis slices of each cell that a region holds: keys, cell, overlap.

    For cells whose exact share is refused; a cell's lattice is a row for each midpoint.
    """
    k = list(keys)
    listed, single = _listed(regions, keys)
    digit = lambda i: F.pmod(F.floor(F.col("_m") / F.lit(per_axis**i)), F.lit(per_axis))
    at = F.array(*[F.get("lo", F.lit(i)) + (F.get("hi", F.lit(i)) - F.get("lo", F.lit(i))) * (digit(i) + 0.5) / per_axis for i in range(axes)])
    rows = cells.select(*k, "cell", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(per_axis**axes - 1))).alias("_m")).select(*k, "cell", "_m", at.alias("x"))
    holds = lambda r: F.forall(F.arrays_zip(F.col("x").alias("x"), r["lo"].alias("l"), r["hi"].alias("h")), lambda v: (v["x"] >= v["l"]) & (v["x"] <= v["h"]))
    met = _meeting(rows, listed, keys).select(*k, "cell", "_m", F.exists("_regions", holds).cast("int").alias("_in"))
    if not single:
        met = met.groupBy(*k, "cell", "_m").agg(F.max("_in").alias("_in"))
    sums = met.groupBy(*k, "cell").agg(F.sum("_in").alias("_in"))
    return cells.select(*k, "cell").join(sums, [*k, "cell"], "left").select(*k, "cell", (F.coalesce("_in", F.lit(0)) / F.lit(per_axis**axes)).alias("overlap"))


def volumes(cells: DataFrame, shares: DataFrame, root: tuple[Sequence[float], Sequence[float]], policy, declared: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Of each atlas: the share of the space by label, certified too coarsely or too thinly, and by label inside the regions.

    shares: each cell's overlap with the union of the regions, null where that was refused; then all that is over the
    union is null. declared: the union's share of the space (keys, declared_union), by which the certified part is read.
    """
    k = list(keys)
    width = F.array(*[F.lit(h - lo) for lo, h in zip(*root, strict=True)])
    part = F.aggregate(F.transform(F.arrays_zip(F.col("lo").alias("l"), F.col("hi").alias("h"), width.alias("w")), lambda v: (v["h"] - v["l"]) / v["w"]), F.lit(1.0), lambda acc, w: acc * w)
    depth = F.pow(F.lit(0.5), F.col("depth").cast("double"))
    met = cells.join(shares, [*k, "cell"]).withColumn("_v", part)
    total = lambda cond, v=None: F.coalesce(F.sum(F.when(cond, F.col("_v") if v is None else v)), F.lit(0.0))
    labels = {n: F.col("label") == n.upper() for n in ("trusted", "suspicious", "unknown", "provisional")}
    sums = met.groupBy(*k).agg(
        *[total(c).alias(f"{n}_volume") for n, c in labels.items()],
        total(labels["trusted"] & (depth > policy.certify_share)).alias("coarse_certified_volume"),
        total(labels["trusted"] & (F.col("samples") / depth < policy.certify_density)).alias("thin_certified_volume"),
        *[total(c, F.col("_v") * F.col("overlap")).alias(f"_{n}") for n, c in labels.items()],
        F.count_if(F.col("overlap").isNull()).alias("refusals"),
    )
    over = [F.when(F.col("refusals") == 0, F.col(f"_{n}")).alias(f"{n}_over_true_union") for n in labels]
    out = sums.select(*k, *[f"{n}_volume" for n in labels], "coarse_certified_volume", "thin_certified_volume", "refusals", *over)
    if declared is None:
        return out
    return out.join(declared, k) if k else out.crossJoin(F.broadcast(declared))  # one row


def _cuts(i: int, lo: Column, hi: Column) -> Column:
    """The bounds of the cell and those of the boxes inside it, on one axis, in order."""
    ends = F.flatten(F.transform("boxes", lambda b: F.array(F.get(b["rlo"], F.lit(i)), F.get(b["rhi"], F.lit(i)))))
    return F.array_sort(F.array_distinct(F.concat(F.array(lo, hi), F.filter(ends, lambda e: (e > lo) & (e < hi)))))


def _pieces(cuts: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), lambda n: F.struct(F.get(cuts, n).alias("l"), F.get(cuts, n + 1).alias("h")))


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _listed(regions: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """Regions as lists of at most about MAX_LIST, by keys (renamed _key), and whether each key has one list only."""
    lists = -(-regions.count() // MAX_LIST) or 1
    part = F.pmod(F.xxhash64("region"), F.lit(lists)).alias("_part")
    packed = regions.select(*[F.col(c).alias(f"_{c}") for c in keys], part, F.struct("region", "lo", "hi").alias("_r"))
    return packed.groupBy(*[f"_{c}" for c in keys], "_part").agg(F.collect_list("_r").alias("_regions")), lists == 1


def _meeting(points: DataFrame, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each point with the lists of its keys: a join on the keys, or without any one row a list."""
    if not keys:
        return points.crossJoin(F.broadcast(listed))  # rows of at most MAX_LIST boxes; one, for all but huge truths
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return points.join(listed, on)


def contains(regions: DataFrame, points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Points with the regions (closed boxes) that hold them."""
    listed, _ = _listed(regions, keys)
    holds = lambda r: F.forall(F.arrays_zip(F.col("x").alias("x"), r["lo"].alias("l"), r["hi"].alias("h")), lambda v: ieee.ge(v["x"], v["l"]) & ieee.le(v["x"], v["h"]))
    found = F.transform(F.filter("_regions", holds), lambda r: r["region"])
    return _meeting(points, listed, keys).select(*points.columns, F.explode(found).alias("region"))


def margin(points: DataFrame, regions: DataFrame, root: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = ()) -> DataFrame:
    """The distance of each point from the nearest region: the sum over axes of what it lies outside, by the axis' width.

    One row a point, without a shuffle of points; where regions are more than MAX_LIST, ids tell points apart.
    """
    listed, single = _listed(regions, keys)
    width = F.array(*[F.lit(h - lo) for lo, h in zip(*root, strict=True)])

    def far(r: Column) -> Column:
        sides = F.arrays_zip(F.col("x").alias("x"), r["lo"].alias("l"), r["hi"].alias("h"), width.alias("w"))
        return F.aggregate(F.transform(sides, lambda v: F.greatest(v["l"] - v["x"], v["x"] - v["h"], F.lit(0.0)) / v["w"]), F.lit(0.0), lambda acc, d: acc + d)

    met = _meeting(points, listed, keys).select(*keys, "id", F.array_min(F.transform("_regions", far)).alias("margin"))
    return met if single else met.groupBy(*keys, "id").agg(F.min("margin").alias("margin"))


def boundary_hits(bands: DataFrame, boundaries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each declared boundary (boundary, axis, at, tolerance) the nearest of the bands' faces and middles on its axis."""
    k = [*keys, "axis"]
    values = bands.select(*k, F.explode(F.array("facing_lo", "facing_hi", (F.col("facing_lo") + F.col("facing_hi")) / 2)).alias("value"))
    near = boundaries.join(values, k, "left").withColumn("miss", F.abs(F.col("value") - F.col("at")))
    out = near.groupBy(*k, "boundary", "at", "tolerance").agg(F.min(F.struct("miss", "value")).alias("best"))
    return out.select(*k, "boundary", "at", "tolerance", F.col("best.value").alias("value"), F.col("best.miss").alias("miss"), F.coalesce(F.col("best.miss") <= F.col("tolerance"), F.lit(False)).alias("hit"))


def false_positive(cells: DataFrame, shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The share of suspicious volume outside the regions; null without suspicious volume, or if a share was refused."""
    met = cells.where("label = 'SUSPICIOUS'").join(shares, [*keys, "cell"])
    v = volume()
    out = met.groupBy(*keys).agg(F.sum(v).alias("v"), F.sum(v * F.col("overlap")).alias("inside"), F.count_if(F.col("overlap").isNull()).alias("refused"))
    return out.select(*keys, F.when(F.col("refused") == 0, 1 - F.try_divide(F.col("inside"), F.col("v"))).alias("false_positive"))


def duplicate_rate(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Findings by the region they overlap most (finding, region, overlap): the share that repeats an earlier one's."""
    best = findings.groupBy(*keys, "finding").agg(F.max_by("region", F.struct("overlap", (-F.col("region")).alias("first"))).alias("region"))
    nth = F.row_number().over(Window.partitionBy(*keys, "region").orderBy("finding"))
    return best.withColumn("nth", nth).groupBy(*keys).agg((F.count_if((F.col("nth") > 1) & F.col("region").isNotNull()) / F.count("*")).alias("duplicate_rate"))
