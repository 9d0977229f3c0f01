"""The dyadic tree of cells as rows: a cell is its depth and one whole number an axis, and its key interleaves their bits.

Cells are halved in turn along the axes, the last axis first, as the widest share of the domain is halved and of equals the
last. So a cell's depth says how often each axis was halved, a parent's key is a prefix of its child's, and a cell's
neighbours of its own size are one step away on some axes. Points are summed up once by their deepest cell; all that
follows (sums of every level, refinement until nothing changes, locating) is over cells, by equality of keys.

A shared face belongs to the lower cell: what is not above the middle goes down. Points outside the domain are in no cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.operators import atlas
from plumbline.plans.scratch import stash

#: Deepest level: keys are whole numbers of 64 bits.
DEEPEST = 60


@dataclass(frozen=True)
class Tree:
    """A domain and the depth to which its cells can be halved."""

    lo: tuple[float, ...]
    hi: tuple[float, ...]
    depth: int

    def __post_init__(self) -> None:
        if not 0 <= self.depth <= DEEPEST:
            raise ValueError(f"a tree is at most {DEEPEST} deep")

    @property
    def axes(self) -> int:
        return len(self.lo)

    @property
    def places(self) -> list[str]:
        """The columns that hold a cell's place on each axis."""
        return [f"c{i}" for i in range(self.axes)]

    def axis_at(self, depth: int) -> int:
        """Which axis a cell of this depth is halved along."""
        return self.axes - 1 - depth % self.axes

    def halved(self, axis: int, depth: int) -> int:
        """How often an axis has been halved at a depth."""
        return sum(self.axis_at(d) == axis for d in range(depth))

    def times(self, axis: int, depth: Column) -> Column:
        return F.get(F.array(*[F.lit(self.halved(axis, d)) for d in range(self.depth + 1)]), depth)

    def key(self, depth: Column) -> Column:
        """The interleaved bits of a cell's places, first halving first."""
        bits = []
        for d in range(self.depth):
            axis = self.axis_at(d)
            shift = F.greatest(self.times(axis, depth) - 1 - self.halved(axis, d), F.lit(0))
            bit = F.call_function("shiftright", F.col(f"c{axis}"), shift).bitwiseAND(F.lit(1).cast("long"))
            bits.append(F.when(F.lit(d) < depth, F.call_function("shiftleft", bit, F.greatest(depth - 1 - d, F.lit(0)))).otherwise(F.lit(0).cast("long")))
        return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("long"))

    def bound(self, axis: int, step: int) -> Column:
        """The lower (step 0) or upper (step 1) bound of a cell on an axis."""
        width = F.lit(self.hi[axis] - self.lo[axis]) / F.pow(F.lit(2.0), self.times(axis, F.col("depth")).cast("double"))
        return F.lit(self.lo[axis]) + (F.col(f"c{axis}") + step) * width

    def prefix(self, depth: Column) -> list[Column]:
        """The places of the cell at a lesser depth that holds this one."""
        return [F.call_function("shiftright", F.col(c), self.times(i, F.col("depth")) - self.times(i, depth)).alias(c) for i, c in enumerate(self.places)]


def _halving(v: Column) -> Callable[[Column, Column], Column]:
    """One halving of (lo, hi, c) towards v."""

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = v > mid
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"), (acc["c"] * 2 + up.cast("long")).alias("c"))

    return halve


def deepest(points: DataFrame, tree: Tree) -> DataFrame:
    """points in the domain with depth, c0.. and key of their deepest cell."""
    inside = reduce(lambda a, b: a & b, [ieee.ge(F.get("x", F.lit(i)), F.lit(tree.lo[i])) & ieee.le(F.get("x", F.lit(i)), F.lit(tree.hi[i])) for i in range(tree.axes)])
    placed = points.where(inside).withColumn("depth", F.lit(tree.depth))
    for i, name in enumerate(tree.places):
        times = tree.halved(i, tree.depth)
        start = F.struct(F.lit(tree.lo[i]).alias("lo"), F.lit(tree.hi[i]).alias("hi"), F.lit(0).cast("long").alias("c"))
        placed = placed.withColumn(name, F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, _halving(F.get("x", F.lit(i))))["c"] if times else F.lit(0).cast("long"))
    return placed.withColumn("key", tree.key(F.col("depth")))


def levels(points: DataFrame, tree: Tree, policy: atlas.Policy = atlas.Policy()) -> DataFrame:
    """(depth, key, c0.., aggregates) of every cell of every depth that holds a point.

    Points are summed up by their deepest cell, on the map side first; each of these is then added to its prefixes.
    """
    deep = deepest(points, tree).groupBy("depth", *tree.places).agg(*atlas.aggregates(policy))
    up = deep.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(tree.depth))))
    held = up.select(F.col("at").alias("depth"), *tree.prefix(F.col("at")), "samples", "risk_sum", "risk_max", "channels", "measured", "facts", "strong", "non_finite")
    sums = [F.sum(c).alias(c) for c in ("samples", "risk_sum", "facts")] + [F.bit_or(c).alias(c) for c in ("channels", "measured")] + [F.max(c).alias(c) for c in ("risk_max", "strong", "non_finite")]
    return held.groupBy("depth", *tree.places).agg(*sums).withColumn("key", tree.key(F.col("depth")))


_EMPTY = {"samples": 0, "risk_sum": 0.0, "risk_max": 0.0, "channels": 0, "measured": 0, "facts": 0, "strong": False, "non_finite": False}


def filed(leaves: DataFrame, sums: DataFrame, tree: Tree, policy: atlas.Policy = atlas.Policy()) -> DataFrame:
    """Leaves with their sums and labels."""
    stats = sums.drop(*tree.places)
    return leaves.join(stats, ["depth", "key"], "left").fillna(_EMPTY).withColumn("label", atlas.classify(policy))


def neighbours(cells: DataFrame, tree: Tree, faces_only: bool = False) -> DataFrame:
    """(depth, key, near_depth, near_key): for each cell the cells of its size that touch it, and what holds these.

    Of two leaves that touch, the smaller finds the larger so: one of the places next to it lies in the larger one.
    """
    steps = [s for s in product((-1, 0, 1), repeat=tree.axes) if any(s) and (not faces_only or sum(map(abs, s)) == 1)]
    moved = cells.select("depth", "key", F.explode(F.array(*[F.struct(*[(F.col(c) + d).alias(c) for c, d in zip(tree.places, s, strict=True)]) for s in steps])).alias("n"))
    moved = moved.select("depth", F.col("key").alias("own"), *[F.col(f"n.{c}").alias(c) for c in tree.places])
    limit = [F.call_function("shiftleft", F.lit(1).cast("long"), tree.times(i, F.col("depth"))) for i in range(tree.axes)]
    there = moved.where(reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < m) for c, m in zip(tree.places, limit, strict=True)]))
    up = there.withColumn("near_depth", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    at = up.select("own", F.col("depth").alias("own_depth"), "near_depth", *tree.prefix(F.col("near_depth")))
    return at.select(F.col("own_depth").alias("depth"), F.col("own").alias("key"), "near_depth", tree.key(F.col("near_depth")).alias("near_key"))


def meetings(cells: DataFrame, tree: Tree) -> DataFrame:
    """(depth, key, near_depth, near_key) of every two measured cells of different sides that touch, each way round."""
    known = cells.where((F.col("samples") > 0) & (F.col("label") != atlas.UNKNOWN)).withColumn("side", atlas.side())
    mine = neighbours(known, tree).join(known.select("depth", "key", "side"), ["depth", "key"])
    theirs = known.select(F.col("depth").alias("near_depth"), F.col("key").alias("near_key"), F.col("side").alias("near_side"))
    met = mine.join(theirs, ["near_depth", "near_key"]).where("side <> near_side").select("depth", "key", "near_depth", "near_key")
    return met.unionByName(met.select(F.col("near_depth").alias("depth"), F.col("near_key").alias("key"), F.col("depth").alias("near_depth"), F.col("key").alias("near_key"))).distinct()


def disagreeing(leaves: DataFrame, met: DataFrame) -> DataFrame:
    """(depth, key) of leaves that meet a leaf of the other side."""
    mine = met.join(leaves.select("depth", "key"), ["depth", "key"])
    theirs = leaves.select(F.col("depth").alias("near_depth"), F.col("key").alias("near_key"))
    return mine.join(theirs, ["near_depth", "near_key"]).select("depth", "key").distinct()


def passes(sums: DataFrame, tree: Tree, policy: atlas.Policy = atlas.Policy()) -> Iterator[DataFrame]:
    """The leaves (depth, key, c0..) after each pass of refinement, from the root on, until none is halved.

    A cell's label follows from its sums, so what a cell of any depth is and which others it meets is found once for all
    passes; a pass only asks which of them are leaves by then.
    """
    spark = sums.sparkSession
    cells = filed(sums.select("depth", *tree.places, "key"), sums, tree, policy)
    wants = (F.col("label") == atlas.SUSPICIOUS) | (atlas.mean_risk() > policy.refine_below)
    if policy.resolution in ("demand", "both"):
        wants = wants | (F.col("label").isin(atlas.TRUSTED, atlas.PROVISIONAL) & policy.unsupported())
    able = (F.col("depth") < tree.depth) & (F.col("samples") >= policy.min_samples)
    said = stash(cells.where(able).select("depth", "key", wants.alias("wants")), "dyadic-said")
    met = stash(meetings(cells, tree).join(said.where("not wants").select("depth", "key"), ["depth", "key"]), "dyadic-met")
    leaves = spark.range(1).select(F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in tree.places], F.lit(0).cast("long").alias("key"))
    axis = F.get(F.array(*[F.lit(tree.axis_at(d)) for d in range(tree.depth + 1)]), F.col("depth"))
    for _ in range(tree.depth + 1):
        yield leaves
        far = disagreeing(leaves, met).withColumn("disagrees", F.lit(True))
        judged = leaves.join(said, ["depth", "key"], "left").join(far, ["depth", "key"], "left")
        halved = F.coalesce(F.col("wants") | F.col("disagrees"), F.lit(False))
        sides = F.explode(F.when(halved, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(-1))))
        split = judged.withColumns({"side": sides, "axis": axis})
        down = lambda c, which: F.when((F.col("side") >= 0) & which, F.col(c) * 2 + F.col("side")).otherwise(F.col(c)).alias(c)
        made = split.select((F.col("depth") + (F.col("side") >= 0).cast("int")).alias("depth"), *[down(c, F.col("axis") == i) for i, c in enumerate(tree.places)], down("key", F.lit(True)), (F.col("side") >= 0).alias("new"))
        made = stash(made, "dyadic")
        leaves = made.drop("new")
        if made.where("new").isEmpty():
            return


def refined(points: DataFrame, tree: Tree, policy: atlas.Policy = atlas.Policy()) -> DataFrame:
    """The filed leaves that points, summed up once, lead to."""
    sums = stash(levels(points, tree, policy), "dyadic-levels")
    leaves = None
    for leaves in passes(sums, tree, policy):
        pass
    return filed(leaves, sums, tree, policy)


def located(points: DataFrame, leaves: DataFrame, tree: Tree) -> DataFrame:
    """points with leaf_depth and leaf_key: a prefix of the point's deepest key; null outside the domain.

    Which leaf holds a deepest cell is looked up for cells, not for points; points then meet one row each.
    """
    placed = deepest(points, tree)
    cells = placed.select("depth", "key", *tree.places).distinct()
    up = cells.withColumn("leaf_depth", F.explode(F.sequence(F.lit(0), F.lit(tree.depth))))
    keyed = up.select(F.col("key").alias("deep"), "leaf_depth", F.call_function("shiftright", F.col("key"), F.lit(tree.depth) - F.col("leaf_depth")).alias("leaf_key"))
    held = keyed.join(leaves.select(F.col("depth").alias("leaf_depth"), F.col("key").alias("leaf_key")), ["leaf_depth", "leaf_key"])
    met = placed.join(held.withColumnRenamed("deep", "key"), "key", "left").select(*points.columns, "leaf_depth", "leaf_key")
    inside = reduce(lambda a, b: a & b, [ieee.ge(F.get("x", F.lit(i)), F.lit(tree.lo[i])) & ieee.le(F.get("x", F.lit(i)), F.lit(tree.hi[i])) for i in range(tree.axes)])
    outside = points.where(~F.coalesce(inside, F.lit(False)))
    return met.unionByName(outside.select("*", F.lit(None).cast("int").alias("leaf_depth"), F.lit(None).cast("long").alias("leaf_key")))


def permitted(bounds: DataFrame, depth: int, cap: int = 1 << 16) -> DataFrame:
    """Every cell that halving may make down to a depth, of the one box (lo, hi) in bounds, by a recursive query.

    The widest share of the box is halved, of equals the last; a cell whose middle is not strictly inside ends its branch.
    More cells than cap, or than the session lets a recursive query make, are refused with ValueError before any is made.
    """
    spark = bounds.sparkSession
    limits = (int(spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")), int(spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")))
    if 2 ** (depth + 1) - 1 > min(cap, limits[0]) or depth >= limits[1]:
        raise ValueError(f"the partition to depth {depth} may hold {2 ** (depth + 1) - 1} cells, more than {min(cap, limits[0])} or deeper than {limits[1]}")
    return spark.sql(
        """
        WITH RECURSIVE box AS (SELECT lo AS rlo, hi AS rhi FROM {bounds}),
        tree(depth, key, lo, hi, axis, mid) AS (
          SELECT 0, 0L, rlo, rhi, cast(size(rlo) - 1 AS int), CASE WHEN size(rlo) > 0 THEN (rlo[size(rlo) - 1] + rhi[size(rlo) - 1]) / 2 END FROM box
          UNION ALL
          SELECT depth, key, lo, hi, axis, (lo[axis] + hi[axis]) / 2 FROM (
            SELECT depth, key, lo, hi, array_max(transform(sequence(0, size(lo) - 1), i -> named_struct('share', (hi[i] - lo[i]) / greatest(rhi[i] - rlo[i], 1e-30D), 'axis', cast(i AS int)))).axis AS axis FROM (
              SELECT depth + 1 AS depth, key * 2 + side AS key,
                     transform(lo, (v, i) -> CASE WHEN i = axis AND side = 1 THEN mid ELSE v END) AS lo,
                     transform(hi, (v, i) -> CASE WHEN i = axis AND side = 0 THEN mid ELSE v END) AS hi, rlo, rhi
              FROM (SELECT t.*, b.rlo, b.rhi, explode(array(0, 1)) AS side FROM tree t JOIN box b ON t.depth < {depth} AND t.mid > t.lo[t.axis] AND t.mid < t.hi[t.axis]))))
        SELECT depth, key, lo, hi FROM tree
        """,
        bounds=bounds,
        depth=depth,
    )
