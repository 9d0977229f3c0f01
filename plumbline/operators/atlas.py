"""The atlas: boxes of the parameter space, what was measured in them, and the label that earns.

Cells are rows (cell, depth, lo, hi) with arrays of bounds; ``seq`` is their place in the leaf order. Points are rows
(id, x, risk, channels, fact, measured), channels and measured being bit masks of channels. ``keys`` tell atlases apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.plans.scratch import stash

TRUSTED, PROVISIONAL, SUSPICIOUS, UNKNOWN = "TRUSTED", "PROVISIONAL", "SUSPICIOUS", "UNKNOWN"
FACE = 1e-12


@dataclass(frozen=True)
class Policy:
    """When a cell is what. trust: current, min-channels-2, non-finite-blocks-trust or both; resolution: current,
    demand, withhold or both; certify: by size or density."""

    suspicious_mean: float = 0.45
    suspicious_peak: float = 0.7
    min_samples: int = 4
    min_channels: int = 1
    max_depth: int = 12
    refine_below: float = 0.12
    suspicious_channels: int = 2
    trust: str = "current"
    resolution: str = "current"
    certify: str = "size"
    certify_share: float = 0.00390625
    certify_density: float = 1024.0

    @property
    def channels_floor(self) -> int:
        return max(self.min_channels, 2 if self.trust in ("min-channels-2", "both") else 0)

    @property
    def blocks_non_finite(self) -> bool:
        return self.trust in ("non-finite-blocks-trust", "both")

    def unsupported(self) -> Column:
        volume = F.pow(F.lit(0.5), F.col("depth").cast("double"))
        return volume > self.certify_share if self.certify == "size" else F.col("samples") / volume < self.certify_density


def aggregates(policy: Policy) -> list[Column]:
    """What classification needs to know of a cell's points."""
    risk = F.col("risk")
    strong = ieee.ge(risk, F.lit(policy.suspicious_mean)) & (F.col("fact") | (F.bit_count("channels") >= policy.suspicious_channels))
    return [
        F.count("risk").alias("samples"),
        F.coalesce(F.sum("risk"), F.lit(0.0)).alias("risk_sum"),
        F.coalesce(F.max(F.when(~F.isnan(risk), F.greatest(risk, F.lit(0.0)))), F.lit(0.0)).alias("risk_max"),
        F.coalesce(F.bit_or("channels"), F.lit(0)).alias("channels"),
        F.coalesce(F.bit_or("measured"), F.lit(0)).alias("measured"),
        F.count_if("fact").alias("facts"),
        F.coalesce(F.bool_or(strong), F.lit(False)).alias("strong"),
        F.coalesce(F.bool_or(~ieee.is_finite(risk)), F.lit(False)).alias("non_finite"),
    ]


def mean_risk() -> Column:
    return F.when(F.col("samples") > 0, F.try_divide(F.col("risk_sum"), F.col("samples").cast("double"))).otherwise(F.lit(0.0))


def classify(policy: Policy = Policy()) -> Column:
    """The label of a cell with aggregates() and depth."""
    flagged = (F.col("risk_max") >= policy.suspicious_peak) | (mean_risk() >= policy.suspicious_mean)
    label = F.when(F.isnan(mean_risk()) | F.isnan("risk_max"), UNKNOWN)
    label = label.when(flagged & F.col("strong"), SUSPICIOUS).when(flagged, UNKNOWN)
    label = label.when(F.col("samples") < policy.min_samples, UNKNOWN)
    if policy.blocks_non_finite:
        label = label.when(F.col("non_finite"), UNKNOWN)
    label = label.when(F.bit_count("measured") < policy.channels_floor, UNKNOWN)
    if policy.resolution in ("withhold", "both"):
        label = label.when(policy.unsupported(), PROVISIONAL)
    return label.otherwise(TRUSTED)


def side() -> Column:
    """0 for UNKNOWN, 1 for SUSPICIOUS, 2 for TRUSTED and PROVISIONAL: what bands and refinement compare."""
    return F.when(F.col("label") == UNKNOWN, 0).when(F.col("label") == SUSPICIOUS, 1).otherwise(2)


def grid_cells(points: DataFrame, bounds: Sequence[tuple[float, float]], splits: Sequence[int], keys: Sequence[str] = (), policy: Policy = Policy()) -> DataFrame:
    """Points binned into 2^splits[i] halves of each axis: an equi-join's worth of work for dyadic leaves.

    A shared face belongs to the lower cell, as a split sends what is not above the middle down. Points outside the
    bounds are in no cell. Returns keys, k (the bin on each axis), depth, lo, hi, aggregates and label.
    """
    inside = F.lit(True)
    ks = []
    for i, ((lo, hi), s) in enumerate(zip(bounds, splits, strict=True)):
        v = F.get("x", F.lit(i))
        inside = inside & ieee.ge(v, F.lit(lo)) & ieee.le(v, F.lit(hi))
        ks.append(F.greatest(F.ceil((v - lo) / F.lit((hi - lo) / (1 << s))) - 1, F.lit(0)).cast("int"))
    binned = points.where(inside).withColumn("k", F.array(*ks))
    cells = binned.groupBy(*keys, "k").agg(*aggregates(policy))
    lo = F.array(*[F.lit(b[0]) + F.get("k", F.lit(i)) * F.lit((b[1] - b[0]) / (1 << s)) for i, (b, s) in enumerate(zip(bounds, splits, strict=True))])
    hi = F.array(*[F.lit(b[0]) + (F.get("k", F.lit(i)) + 1) * F.lit((b[1] - b[0]) / (1 << s)) for i, (b, s) in enumerate(zip(bounds, splits, strict=True))])
    placed = cells.withColumns({"depth": F.lit(sum(splits)), "lo": lo, "hi": hi})
    return placed.withColumn("label", classify(policy))


def inside(x: str = "x", lo: str = "lo", hi: str = "hi") -> Column:
    """Whether a point is in a closed box."""
    return F.forall(F.arrays_zip(F.col(x).alias("x"), F.col(lo).alias("lo"), F.col(hi).alias("hi")), lambda v: ieee.ge(v["x"], v["lo"]) & ieee.le(v["x"], v["hi"]))


def locate(points: DataFrame, leaves: DataFrame, keys: Sequence[str] = (), bins: int = 256, span: tuple[float, float] | None = None) -> DataFrame:
    """Each point with the first leaf (by seq) whose closed box holds it: points' columns and cell; null where none does.

    A range join by an equi-join: the first axis is cut into bins, a bin lists the leaves that touch it in order, and a
    point looks through its own bin's. So each point meets one row, and rows that are alike stay as many as they are.
    span: the first axis' bounds, if they are known.
    """
    k = list(keys)
    if span is None:
        span = tuple(leaves.agg(F.min(F.get("lo", F.lit(0))), F.max(F.get("hi", F.lit(0)))).first())
        if span[0] is None:
            return points.withColumn("cell", F.lit(None).cast("int"))
    lo, width = span[0], (span[1] - span[0]) / bins or 1.0

    def bin_of(v: Column) -> Column:
        return F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")

    known = ~F.isnan(F.get("x", F.lit(0)))
    numbered = points.withColumn("_bin", F.when(known, bin_of(F.get("x", F.lit(0)))))
    spread = leaves.select(*[F.col(c).alias(f"_{c}") for c in k], F.struct("seq", "cell", "lo", "hi").alias("_leaf"), F.explode(F.sequence(bin_of(F.get("lo", F.lit(0))), bin_of(F.get("hi", F.lit(0))))).alias("_b"))
    listed = spread.groupBy(*[f"_{c}" for c in k], "_b").agg(F.sort_array(F.collect_list("_leaf")).alias("_leaves"))
    on = F.col("_bin") == F.col("_b")
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    holds = lambda leaf: F.forall(F.arrays_zip(F.col("x").alias("x"), leaf["lo"].alias("lo"), leaf["hi"].alias("hi")), lambda v: ieee.ge(v["x"], v["lo"]) & ieee.le(v["x"], v["hi"]))
    found = F.get(F.filter("_leaves", holds), F.lit(0))["cell"]
    return numbered.join(listed, on, "left").select(*points.columns, found.alias("cell"))


def filed(points: DataFrame, leaves: DataFrame, keys: Sequence[str] = (), policy: Policy = Policy()) -> DataFrame:
    """Leaves with their points' aggregates and labels; points carry cell."""
    k = list(keys)
    stats = points.groupBy(*k, "cell").agg(*aggregates(policy))
    base = leaves.select(*k, "cell", "seq", "depth", "lo", "hi")
    met = base.join(stats, [*k, "cell"], "left")
    empty = {"samples": 0, "risk_sum": 0.0, "risk_max": 0.0, "channels": 0, "measured": 0, "facts": 0, "strong": False, "non_finite": False}
    return met.fillna(empty).withColumn("label", classify(policy))


def touching(a: str, b: str) -> Column:
    """Whether two closed boxes, whose bounds have these prefixes, meet."""
    return F.forall(F.arrays_zip(F.col(f"{a}lo").alias("al"), F.col(f"{a}hi").alias("ah"), F.col(f"{b}lo").alias("bl"), F.col(f"{b}hi").alias("bh")), lambda v: (v["ah"] >= v["bl"] - FACE) & (v["bh"] >= v["al"] - FACE))


def disagreeing(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Measured cells that touch one of the other side: keys, cell."""
    k = list(keys)
    known = cells.where((F.col("samples") > 0) & (F.col("label") != UNKNOWN)).withColumn("side", side())
    a = known.select(*k, "cell", F.col("side").alias("s"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in k], F.col("side").alias("t"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    on = (F.col("s") != F.col("t")) & touching("a_", "b_")
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return a.join(b, on, "left_semi").select(*k, "cell")


def split_axis(root_lo: Column, root_hi: Column) -> Column:
    """The axis of the largest width relative to the root's, the last of equals."""
    shares = F.transform(F.arrays_zip(F.col("lo").alias("lo"), F.col("hi").alias("hi"), root_lo.alias("rl"), root_hi.alias("rh")), lambda v, i: F.struct(((v["hi"] - v["lo"]) / F.greatest(v["rh"] - v["rl"], F.lit(1e-30))).alias("share"), i.alias("axis")))
    return F.array_max(shares)["axis"]


def refine(cells: DataFrame, points: DataFrame, root: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = (), policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """One pass: leaves worth it are halved, and points go to the halves. cells as filed(); returns leaves and points.

    Kept leaves come first in the new order, then halves. What is not above the middle goes to the lower half.
    """
    k = list(keys)
    wants = (F.col("label") == SUSPICIOUS) | (mean_risk() > policy.refine_below) | F.col("disagrees")
    if policy.resolution in ("demand", "both"):
        wants = wants | (F.col("label").isin(TRUSTED, PROVISIONAL) & policy.unsupported())
    far = disagreeing(cells, k).withColumn("disagrees", F.lit(True))
    judged = cells.join(far, [*k, "cell"], "left").fillna({"disagrees": False})
    lo, hi = F.array(*map(F.lit, root[0])), F.array(*map(F.lit, root[1]))
    judged = judged.withColumn("axis", split_axis(lo, hi)).withColumn("mid", (F.get("lo", F.col("axis")) + F.get("hi", F.col("axis"))) / 2)
    possible = (F.col("depth") < policy.max_depth) & (F.col("samples") >= policy.min_samples) & ieee.is_finite(F.col("mid")) & (F.col("mid") > F.get("lo", F.col("axis"))) & (F.col("mid") < F.get("hi", F.col("axis")))
    judged = judged.withColumn("halved", possible & wants)
    base = judged.groupBy(*k).agg(F.max("cell").alias("top")) if k else judged.agg(F.max("cell").alias("top"))
    # New cells take the next numbers in the leaf order, two for each halved leaf.
    order = Window.partitionBy(*[F.col(c) for c in k]).orderBy("seq")
    nth = F.sum(F.col("halved").cast("int")).over(order)
    numbered = judged.withColumn("nth", nth)
    numbered = numbered.join(base, k) if k else numbered.crossJoin(F.broadcast(base))  # one row
    kept = numbered.where("not halved").select(*k, "cell", F.struct(F.lit(0).alias("new"), F.col("seq").cast("long").alias("at")).alias("place"), "depth", "lo", "hi")
    halves = numbered.where("halved").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    new_id = (F.col("top") + 2 * F.col("nth") - 1 + F.col("side")).cast("int")
    cut = lambda name, at: F.transform(name, lambda v, i: F.when((i == F.col("axis")) & (F.col("side") == at), F.col("mid")).otherwise(v))
    halves = halves.select(*k, new_id.alias("cell"), F.struct(F.lit(1).alias("new"), new_id.cast("long").alias("at")).alias("place"), (F.col("depth") + 1).alias("depth"), cut("lo", 1).alias("lo"), cut("hi", 0).alias("hi"))
    leaves = kept.unionByName(halves).withColumn("seq", F.row_number().over(Window.partitionBy(*[F.col(c) for c in k]).orderBy("place")) - 1).drop("place")
    where_to = numbered.where("halved").select(*k, F.col("cell"), "axis", "mid", (F.col("top") + 2 * F.col("nth") - 1).alias("first"))
    moved = points.join(where_to, [*k, "cell"], "left")
    target = F.when(F.col("first").isNull(), F.col("cell")).otherwise(F.col("first") + F.when(ieee.le(F.get("x", F.col("axis")), F.col("mid")), 0).otherwise(1))
    return leaves, moved.withColumn("cell", target.cast("int")).select(*points.columns)


def build(points: DataFrame, root: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = (), policy: Policy = Policy(), passes: int = 12) -> tuple[DataFrame, DataFrame]:
    """The atlas of a finished set of points: passes of refine until no leaf splits. Returns filed leaves and points."""
    k = list(keys)
    one = points.select(*k).distinct() if k else points.sparkSession.range(1).select()
    leaves = one.select(*k, F.lit(0).alias("cell"), F.lit(0).alias("seq"), F.lit(0).alias("depth"), F.array(*map(F.lit, root[0])).alias("lo"), F.array(*map(F.lit, root[1])).alias("hi"))
    in_root = points.withColumn("_lo", F.array(*map(F.lit, root[0]))).withColumn("_hi", F.array(*map(F.lit, root[1]))).where(inside("x", "_lo", "_hi")).drop("_lo", "_hi")
    filed_points = in_root.withColumn("cell", F.lit(0))
    cells, n = stash(filed(filed_points, leaves, k, policy), "atlas"), None
    for _ in range(passes):
        leaves, filed_points = refine(cells, filed_points, root, k, policy)
        filed_points = stash(filed_points, "atlas-points")
        cells = stash(filed(filed_points, leaves, k, policy), "atlas")
        if (now := cells.count()) == n:
            break
        n = now
    return cells, filed_points


def relative_volume(root: tuple[Sequence[float], Sequence[float]]) -> Column:
    out = F.lit(1.0)
    for i, (lo, hi) in enumerate(zip(*root, strict=True)):
        out = out * (F.get("hi", F.lit(i)) - F.get("lo", F.lit(i))) / (hi - lo)
    return out


def coverage(cells: DataFrame, root: tuple[Sequence[float], Sequence[float]], keys: Sequence[str] = ()) -> DataFrame:
    """Volume fractions by label, cells and samples."""
    v = relative_volume(root)
    part = lambda label: F.sum(F.when(F.col("label") == label, v).otherwise(F.lit(0.0))).alias(label.lower())
    sized = cells.groupBy(*keys).agg(part(TRUSTED), part(SUSPICIOUS), part(UNKNOWN), part(PROVISIONAL), F.count("*").alias("cells"), F.sum("samples").alias("samples"))
    return sized.withColumn("resolved", F.col("trusted") + F.col("suspicious") + F.col("provisional"))


def raw_bands(cells: DataFrame, axes: int, keys: Sequence[str] = ()) -> DataFrame:
    """For each two measured cells of different sides: every axis that separates them while they overlap on the others."""
    k = list(keys)
    known = cells.where((F.col("samples") > 0) & (F.col("label") != UNKNOWN)).withColumn("side", side())
    a = known.select(*k, F.col("seq").alias("p"), F.col("side").alias("s"), F.col("lo").alias("al"), F.col("hi").alias("ah"))
    b = known.select(*[F.col(c).alias(f"b_{c}") for c in k], F.col("seq").alias("q"), F.col("side").alias("t"), F.col("lo").alias("bl"), F.col("hi").alias("bh"))
    on = (F.col("p") < F.col("q")) & (F.col("s") != F.col("t"))
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    at = lambda name, i: F.get(name, F.lit(i))
    found = []
    for i in range(axes):
        apart = (at("ah", i) <= at("bl", i) + FACE) | (at("bh", i) <= at("al", i) + FACE)
        for j in range(axes):
            if j != i:
                apart = apart & (at("ah", j) >= at("bl", j) - FACE) & (at("bh", j) >= at("al", j) - FACE)
        band = F.struct(F.lit(i).alias("axis"), F.least(at("al", i), at("bl", i)).alias("lo"), F.greatest(at("ah", i), at("bh", i)).alias("hi"), F.least(at("ah", i), at("bh", i)).alias("facing_lo"), F.greatest(at("al", i), at("bl", i)).alias("facing_hi"))
        found.append(F.when(apart, band))
    rows = a.join(b, on).select(*k, F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("v"))
    return rows.select(*k, "v.*")


def merge_bands(bands: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Bands of an axis that overlap become one, which counts its transitions: gaps and islands."""
    k = [*keys, "axis"]
    order = Window.partitionBy(*k).orderBy("lo", "hi", "facing_lo", "facing_hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = bands.withColumn("fresh", (F.col("lo") <= reach).isNull() | (F.col("lo") > reach))
    islands = starts.withColumn("island", F.sum(F.col("fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*k, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("facing_lo").alias("facing_lo"), F.max("facing_hi").alias("facing_hi"), F.count("*").alias("transitions"))
    return merged.drop("island")


def findings(cells: DataFrame, points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """For each suspicious leaf the first point of the largest risk in its closed box."""
    k = list(keys)
    bad = cells.where(F.col("label") == SUSPICIOUS).select(*k, "cell", "lo", "hi")
    best = points.join(bad, [*k, "cell"]).where(inside()).groupBy(*k, "cell").agg(F.max_by(F.struct("id", "x", "risk"), F.struct("risk", (-F.col("id")).alias("first"))).alias("p"))
    return bad.join(best, [*k, "cell"]).select(*k, "cell", "lo", "hi", F.col("p.id").alias("id"), F.col("p.x").alias("x"), F.col("p.risk").alias("risk"))


def signature(evidence: DataFrame, by: Sequence[str], least: float = 0.5) -> DataFrame:
    """The sorted distinct channel|subject of each set's strong items."""
    return evidence.where(F.col("strength") >= least).groupBy(*by).agg(F.sort_array(F.collect_set(F.concat_ws("|", "channel", "subject"))).alias("signature"))
