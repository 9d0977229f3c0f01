"""Failing points reduced to what makes them fail, all at once: each round judges one candidate of every point.

Cases are rows with x, a point at which a rule of a loop-free model is broken. An axis that can go back to its usual value
with the rule still broken has nothing to do with the failure: axes are tried in turn, and again until a whole turn changes
nothing, so that no single axis of the result can go back. What is left is then followed along each axis towards the
domain's ends, to where the failure stops: by halving, for a number of rounds that the wanted precision tells.

Every round is a projection of the cases (Columns of the model at the candidates), so no point waits for another, and work
grows with cases times axes; the ends of a case meet again in one grouping by its number. Cases at which nothing is broken have verified false and stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.lang import columns
from plumbline.lang.model import Model
from plumbline.operators import evidence
from plumbline.plans.scratch import stash

#: Rounds of halving between tables that are written, so that no plan grows with the precision.
STEP = 10


def broken_at(cases: DataFrame, model: Model, at: Column, name: str) -> DataFrame:
    """cases with whether a rule is broken at another point."""
    keep = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(cases.columns)]
    made = columns.run_model(cases.select(*keep, at.alias("x")), model)
    judged = evidence.violates(columns.rules_of(model), F.col("y"))
    return made.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(cases.columns)], judged.alias(name))


def _with(x: str, axis: int | Column, value: Column) -> Column:
    return F.transform(x, lambda v, i: F.when(i == axis, value).otherwise(v))


def reduced(cases: DataFrame, model: Model, usual: Sequence[float]) -> DataFrame:
    """cases with verified, core (the point with all axes that can go back at their usual value) and free (these axes)."""
    axes = len(model.params)
    out = broken_at(cases.withColumn("core", F.col("x")), model, F.col("x"), "verified")
    for _ in range(axes):
        for i in range(axes):
            back = _with("core", i, F.lit(float(usual[i])))
            out = broken_at(out, model, back, "_still").withColumn("core", F.when(F.col("verified") & F.col("_still"), back).otherwise(F.col("core"))).drop("_still")
        out = stash(out, "minimal")
        # Another turn only where one has changed something: the last axis that went back may have freed an earlier one.
        tries = [F.get("core", F.lit(i)) != float(usual[i]) for i in range(axes)]
        if out.where(F.col("verified") & reduce(lambda a, b: a | b, tries)).isEmpty():
            break
    free = F.filter(F.sequence(F.lit(0), F.lit(axes - 1)), lambda i: F.get("core", i) == F.get(F.array(*[F.lit(float(u)) for u in usual]), i))
    return out.withColumn("free", F.when(F.col("verified"), free).otherwise(F.array().cast("array<int>")))


def edges(cases: DataFrame, model: Model, rounds: int = 40) -> DataFrame:
    """cases of reduced() with lo and hi: along each axis that is not free, from core to where the failure stops.

    Halving finds one end of the failure each way, the nearest to the domain's end where there are several between. Free
    axes keep the whole domain, axes of choices the core's.
    """
    numbered = stash(cases.withColumn("_id", F.monotonically_increasing_id()), "minimal-cases")
    ends = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(k).alias("side"), F.lit(float(end)).alias("end"), F.lit(p.discrete).alias("choice")) for i, p in enumerate(model.params) for k, end in enumerate((p.lo, p.hi))])
    rows = numbered.select("_id", "core", "free", "verified", F.explode(ends).alias("e")).select("_id", "core", "free", "verified", "e.*")
    rows = broken_at(rows, model, _with("core", F.col("axis"), F.col("end")), "_end")
    whole = ~F.col("choice") & (F.col("_end") | F.array_contains("free", F.col("axis")) | ~F.col("verified"))
    rows = rows.select("_id", "core", "axis", "side", "choice", F.when(whole, F.col("end")).otherwise(F.get("core", F.col("axis"))).alias("good"), F.col("end").alias("bad"))
    for k in range(rounds):
        mid = (F.col("good") + F.col("bad")) / 2
        rows = broken_at(rows, model, _with("core", F.col("axis"), mid), "_in")
        rows = rows.withColumns({"good": F.when(F.col("_in") & ~F.col("choice"), mid).otherwise(F.col("good")), "bad": F.when(F.col("_in"), F.col("bad")).otherwise(mid)}).drop("_in")
        if k % STEP == STEP - 1:
            rows = stash(rows, "minimal-edges")
    told = rows.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("axis", "side", "good"))).alias("all"))  # two an axis
    side = lambda k: F.transform(F.filter("all", lambda v: v["side"] == k), lambda v: v["good"])
    return numbered.join(told.select("_id", side(0).alias("lo"), side(1).alias("hi")), "_id").drop("_id")
