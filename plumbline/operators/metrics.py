"""Measures over outcomes: one row for each (entry, strategy, seed, budget)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SWEEP = ("entry", "strategy", "seed")


def ladder(outcomes: DataFrame, by: Sequence[str] = SWEEP) -> DataFrame:
    """First budgets of each sweep: detected_at (a region), localised_at (all regions), clean_at (for controls).

    A control is clean from its first budget after the last with suspicious volume.
    """
    declared = F.col("declared_regions") > 0
    last_bad = F.max(F.when(F.col("suspicious") > 0, F.col("budget"))).over(Window.partitionBy(*by))
    rows = outcomes.withColumn("last_bad", last_bad)
    first = lambda cond: F.min(F.when(cond, F.col("budget")))
    return rows.groupBy(*by).agg(
        first(declared & (F.col("detected_regions") > 0)).alias("detected_at"),
        first(declared & (F.col("localised_regions") == F.col("declared_regions"))).alias("localised_at"),
        first(~declared & (F.col("budget") > F.coalesce("last_bad", F.lit(-1)))).alias("clean_at"),
    )


def verdict(sweeps: DataFrame, ours: str = "adaptive", measure: str = "localised_at") -> DataFrame:
    """For each entry and seed: whether ours needs a smaller budget than the best other strategy (null: never)."""
    never = F.lit(1 << 60)
    best = sweeps.groupBy("entry", "seed").agg(
        F.min(F.when(F.col("strategy") == ours, F.coalesce(measure, never))).alias("mine"),
        F.min(F.when(F.col("strategy") != ours, F.coalesce(measure, never))).alias("others"),
    )
    said = F.when(F.col("mine") < F.col("others"), "win").when(F.col("mine") > F.col("others"), "loss").otherwise("tie")
    back = lambda c: F.when(F.col(c) < never, F.col(c)).alias(c)
    return best.select("entry", "seed", back("mine"), back("others"), said.alias("verdict"))


def ablation(full: DataFrame, arm: DataFrame, on: Sequence[str] = (*SWEEP, "budget"), measure: str = "localised") -> DataFrame:
    """Rows of two arms paired by their key: one row of tallies; rows that one arm lacks count as unpaired."""
    a = full.select(*on, F.col(measure).alias("f"), F.lit(1).alias("in_f"))
    b = arm.select(*on, F.col(measure).alias("a"), F.lit(1).alias("in_a"))
    met = a.join(b, list(on), "full")
    paired = F.col("in_f").isNotNull() & F.col("in_a").isNotNull()
    n = lambda cond, name: F.count_if(cond).alias(name)
    return met.agg(
        n(paired & F.col("f") & ~F.col("a"), "full_only"),
        n(paired & F.col("a") & ~F.col("f"), "arm_only"),
        n(paired & F.col("f") & F.col("a"), "both"),
        n(paired & ~F.col("f") & ~F.col("a"), "neither"),
        n(paired & (F.col("f").isNull() | F.col("a").isNull()), "not_applicable"),
        n(~paired, "unpaired"),
    )


def best_rows(outcomes: DataFrame, measures: Sequence[str], by: Sequence[str] = ("entry", "strategy")) -> DataFrame:
    """For each entry and strategy the row of the most localised regions, then evaluations, the last of equals by seed and budget."""
    rank = F.struct("localised_regions", "evaluations", "seed", "budget")
    return outcomes.groupBy(*by).agg(F.max_by(F.struct(*measures), rank).alias("m")).select(*by, "m.*")


def grouped(outcomes: DataFrame, sets: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by several groupings in one pass."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    cols = [F.col(c) for c in names]
    return outcomes.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(*aggregates)


def paired_deltas(outcomes: DataFrame, arm_a: str, arm_b: str, measure: str, on: Sequence[str] = (*SWEEP, "budget")) -> DataFrame:
    """measure in arm_b less that in arm_a, where both have it."""
    side = lambda arm, name: outcomes.where(F.col("arm") == arm).select(*on, F.col(measure).alias(name))
    return side(arm_a, "a").join(side(arm_b, "b"), list(on)).where("a is not null and b is not null").withColumn("delta", F.col("b") - F.col("a"))


def census(evidence: DataFrame, keys: Sequence[str] = (), strong: float = 0.5, applied: DataFrame | None = None, findings: DataFrame | None = None, silenced: Sequence[str] = ()) -> DataFrame:
    """Of each channel: readings, strong ones and those without weight.

    applied (keys, channel, applied, computed): how often a channel ran and gave a number. findings (keys, finding,
    channel): the channels that speak in a finding. With both: those counts too, and whether the channel was silenced.
    """
    k = [*keys, "channel"]
    out = evidence.groupBy(*k).agg(F.count("*").alias("readings"), F.count_if(F.col("strength") >= strong).alias("strong"), F.count_if(F.col("strength") <= 0).alias("silenced"))
    if applied is None or findings is None:
        return out
    found = findings.groupBy(*k).agg(F.countDistinct("finding").alias("findings"))
    met = applied.join(out.drop("silenced"), k, "left").join(found, k, "left").fillna(0, ["readings", "strong", "findings"])
    return met.select(*k, "applied", "computed", "readings", "strong", "findings", F.col("channel").isin(list(silenced)).alias("silenced") if silenced else F.lit(False).alias("silenced"))


def ablation_pairs(full: DataFrame, arm: DataFrame, plans: DataFrame, on: Sequence[str] = (*SWEEP, "budget")) -> DataFrame:
    """Two arms row by row: status, and by how much suspicious volume a control moved.

    Outcomes are rows (entry, strategy, seed, budget, control, localised, evaluations, suspicious). An arm is refused as a
    whole (one row, status "refused", reason) where plans (field, full, arm) differ or a row of the arm has no partner,
    or was charged otherwise. Statuses: both, neither, full_only, arm_only, and for rows that both localise at their
    sweep's first such budget: earlier or later where the arm needs a smaller or larger one.
    """
    k = list(on)
    sweep = [c for c in k if c != "budget"]
    first = lambda d, name: d.groupBy(*sweep).agg(F.min(F.when(F.col("localised"), F.col("budget"))).alias(name))
    a = full.select(*k, F.col("control"), F.col("localised").alias("_f"), F.col("evaluations").alias("_fe"), F.col("suspicious").alias("_fs"), F.lit(True).alias("_in"))
    b = arm.select(*k, F.col("localised").alias("_a"), F.col("evaluations").alias("_ae"), F.col("suspicious").alias("_as"))
    met = b.join(a, k, "left").join(first(full, "_first_f"), sweep, "left").join(first(arm, "_first_a"), sweep, "left")
    wrong = plans.where(~F.col("full").eqNullSafe(F.col("arm"))).select(F.concat(F.lit("plans differ in "), "field").alias("reason"))
    alone = met.where(F.col("_in").isNull()).select(F.concat(F.lit("no partner for "), F.concat_ws("/", *[F.col(c).cast("string") for c in k])).alias("reason"))
    charged = met.where(F.col("_fe") != F.col("_ae")).select(F.concat(F.lit("charged otherwise: "), F.concat_ws("/", *[F.col(c).cast("string") for c in k])).alias("reason"))
    refused = wrong.unionByName(alone).unionByName(charged).agg(F.min("reason").alias("reason"))
    status = F.when(F.col("_f") & ~F.col("_a"), "full_only").when(F.col("_a") & ~F.col("_f"), "arm_only").when(~F.col("_f") & ~F.col("_a"), "neither")
    status = status.when((F.col("_first_a") < F.col("_first_f")) & (F.col("budget") == F.col("_first_f")), "earlier").when((F.col("_first_a") > F.col("_first_f")) & (F.col("budget") == F.col("_first_a")), "later").otherwise("both")
    delta = F.when(F.col("control"), F.col("_as") - F.col("_fs"))
    rows = met.crossJoin(F.broadcast(refused)).where("reason is null")  # one row
    said = rows.select(*k, status.alias("status"), delta.alias("control_delta"), F.lit(None).cast("string").alias("reason"))
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in met.select(*k).schema}
    return said.unionByName(refused.where("reason is not null").select(*[v.alias(n) for n, v in nulls.items()], F.lit("refused").alias("status"), F.lit(None).cast("double").alias("control_delta"), "reason"))


def certified_over_region(outcomes: DataFrame, by: Sequence[str] = ("arm", "entry")) -> DataFrame:
    """How much of the declared regions was certified, by arm and entry: means over the rows that can say, and counts of the others.

    A row cannot be measured where the geometry refused, and has no such share where nothing is declared.
    """
    state = F.when(F.col("refusals") != 0, "not_measurable").when(F.col("declared_union") <= 0, "not_applicable").otherwise("measured")
    rows = outcomes.withColumn("_state", state)
    mine = F.col("_state") == "measured"
    n = lambda s: F.count_if(F.col("_state") == s).alias(s)
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), n("measured"), n("not_applicable"), n("not_measurable"),
        F.avg(F.when(mine, F.try_divide(F.col("trusted_over_true_union"), F.col("declared_union")))).alias("certified_over_region_share"),
        F.avg(F.when(mine, F.col("trusted_volume") - F.col("trusted_over_true_union"))).alias("clean_certified_volume"),
        F.avg("trusted_volume").alias("trusted_volume"),
    )


def exchange(tables: DataFrame, base: str, arms: str = "arm", on: Sequence[str] = ("entry",)) -> DataFrame:
    """Against a base arm: the certified share of regions given up, and the clean certification lost for it, as a rate; and what is retained."""
    k = list(on)
    b = tables.where(F.col(arms) == base).select(*k, F.col("certified_over_region_share").alias("_s"), F.col("clean_certified_volume").alias("_c"))
    met = tables.where(F.col(arms) != base).join(b, k)
    fall, cost = F.col("_s") - F.col("certified_over_region_share"), F.col("_c") - F.col("clean_certified_volume")
    return met.select(arms, *k, fall.alias("fall"), cost.alias("cost"), F.try_divide(cost, fall).alias("rate"), F.try_divide(F.col("clean_certified_volume"), F.col("_c")).alias("retained"))


def row_trace(cells: DataFrame, points: DataFrame, regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cells that share volume with a region, with the points inside both: keys, cell, region, label, points, risky."""
    k = list(keys)
    r = regions.select(*[F.col(c).alias(f"_{c}") for c in k], "region", F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    on = F.forall(F.arrays_zip(F.col("lo").alias("l"), F.col("hi").alias("h"), F.col("rlo").alias("rl"), F.col("rhi").alias("rh")), lambda v: (v["l"] < v["rh"]) & (v["h"] > v["rl"]))
    for c in k:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = cells.join(r, on).select(*k, "cell", "label", "region", "rlo", "rhi")
    # Points come with their cell, so they meet by it; only those of cells that a region touches are looked at.
    inside = F.forall(F.arrays_zip(F.col("x").alias("x"), F.col("rlo").alias("l"), F.col("rhi").alias("h")), lambda v: (v["x"] >= v["l"]) & (v["x"] <= v["h"]))
    hit = points.select(*k, "cell", "x", "risk").join(met, [*k, "cell"]).where(inside).groupBy(*k, "cell", "region").agg(F.count("*").alias("points"), F.count_if(F.col("risk") >= 0.45).alias("risky"))
    return met.select(*k, "cell", "label", "region").join(hit, [*k, "cell", "region"], "left").fillna(0, ["points", "risky"])
