"""Evidence: what recorded executions say against a model, as rows of one shape.

Observations are rows (id, x, y, and traces where there are), probes are rows (base, perturbed, axis), swaps rows
(base, swapped, a, b). ``keys`` names further columns that tell campaigns apart; every join and group is within them.
Evidence rows have the keys and: channel, subject, magnitude, strength (fixed items only), observations, fixed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.functions.median import medians
from plumbline.operators.lookup import looked_up
from plumbline.plans.scratch import stash

#: An item names so many of its offenders, the least; the functions ..._offenders give all of them, row by row.
NAMED = 512
CHANNELS = ("Behavioral", "Physical", "Numerical", "Differential", "Sensitivity")


@dataclass(frozen=True)
class Rule:
    """A declared constraint; op is one of < <= > >= ~ and finite, which has no right side."""

    id: int
    left: Column
    op: str
    right: Column | None = None
    tolerance: float = 0.0

    @property
    def tol(self) -> float:
        return self.tolerance or 1e-9


def _item(channel: str, subject: Column, magnitude: Column, observations: Column, strength: Column | None = None) -> list[Column]:
    return [
        F.lit(channel).alias("channel"),
        subject.alias("subject"),
        magnitude.cast("double").alias("magnitude"),
        (F.lit(0.0) if strength is None else strength).cast("double").alias("strength"),
        observations.alias("observations"),
        F.lit(strength is not None).alias("fixed"),
    ]


def _none() -> Column:
    return F.array().cast("array<bigint>")


def violation(rule: Rule) -> Column:
    """How far the rule is violated; null where it holds or cannot be read."""
    left = rule.left
    if rule.op == "finite":
        return F.when(~ieee.is_finite(left), F.lit(1.0))
    right = rule.right
    readable = ieee.is_finite(left) & ieee.is_finite(right)
    gap = F.abs(left - right)
    if rule.op == "~":
        over = gap / (F.lit(rule.tol) * F.greatest(F.abs(right), F.lit(1.0))) - 1
        return F.when(readable & (over > 0), over)
    holds = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[rule.op]
    return F.when(readable & ~holds, gap / F.greatest(F.abs(left), F.abs(right), F.lit(1.0)))


def margin(rule: Rule) -> Column:
    """Signed distance to the rule's edge, positive inside."""
    left, right = rule.left, rule.right
    if rule.op == "finite":
        return F.when(ieee.is_finite(left), F.lit(1.0)).otherwise(F.lit(-1.0))
    if rule.op == "~":
        band = F.lit(rule.tol) * F.greatest(F.abs(right), F.lit(1.0))
        gap = (band - F.abs(left - right)) / band
    else:
        sign = 1 if rule.op in (">", ">=") else -1
        gap = sign * (left - right) / F.greatest(F.abs(left), F.abs(right), F.lit(1.0))
    return F.when(ieee.is_finite(left) & ieee.is_finite(right), gap).otherwise(F.lit(-1.0))


def level(rules: Sequence[Rule]) -> Column:
    """The worst margin over all rules; null without rules."""
    margins = [margin(r) for r in rules]
    return margins[0] if len(margins) == 1 else F.least(*margins) if margins else F.lit(None).cast("double")


def violates(rules: Sequence[Rule], outputs: Column | None = None) -> Column:
    """Whether a rule is violated or an output is not finite."""
    parts = [violation(r).isNotNull() for r in rules]
    if outputs is not None:
        parts.append(F.exists(outputs, lambda v: ~ieee.is_finite(v)))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def constraints(observations: DataFrame, rules: Sequence[Rule], keys: Sequence[str] = ()) -> DataFrame:
    """One fixed item of the physical channel for each rule and observation that violates it."""
    found = F.array(*[F.struct(F.lit(f"require{r.id}").alias("subject"), violation(r).alias("magnitude")) for r in rules])
    rows = observations.select(*keys, "id", F.explode(F.filter(found, lambda v: v["magnitude"].isNotNull())).alias("v"))
    return rows.select(*keys, *_item("Physical", F.col("v.subject"), F.col("v.magnitude"), F.array("id"), F.lit(1.0)))


def divergence(observations: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """NaN outputs as fixed items of strength 1, infinite ones of 0.9."""
    rows = observations.select(*keys, "id", F.posexplode("y").alias("output", "v")).where(~ieee.is_finite(F.col("v")))
    strength = F.when(F.isnan("v"), F.lit(1.0)).otherwise(F.lit(0.9))
    return rows.select(*keys, *_item("Physical", F.concat(F.lit("o"), "output", F.lit(":divergent")), F.lit(1.0), F.array("id"), strength))


def probe_values(observations: DataFrame, probes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Probe pairs with both ends' x along the axis and each output: keys, base, perturbed, axis, output, x0, x1, y0, y1."""
    k = list(keys)
    at = observations.select(*k, F.col("id").alias("base"), F.col("x").alias("bx"), F.col("y").alias("by"))
    to = observations.select(*k, F.col("id").alias("perturbed"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = probes.join(at, [*k, "base"]).join(to, [*k, "perturbed"])
    met = met.select(*k, "base", "perturbed", "axis", F.get("bx", F.col("axis")).alias("x0"), F.get("px", F.col("axis")).alias("x1"), F.posexplode(F.arrays_zip("by", "py")).alias("output", "y"))
    return met.select(*k, "base", "perturbed", "axis", "output", "x0", "x1", F.col("y.by").alias("y0"), F.col("y.py").alias("y1"))


def _both_finite() -> Column:
    return ieee.is_finite(F.col("y0")) & ieee.is_finite(F.col("y1"))


def slopes(values: DataFrame) -> DataFrame:
    """Pairs with a slope |dy| / |dx|; those that do not move, or have an end that is not finite, have none."""
    return values.where(_both_finite() & (F.col("x0") != F.col("x1"))).withColumn("slope", F.abs(F.col("y1") - F.col("y0")) / F.abs(F.col("x1") - F.col("x0")))


def slope_reference(values: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The median slope of each axis and output."""
    return _typical(stash(slopes(values), "slopes"), keys)


def _typical(steep: DataFrame, keys: Sequence[str]) -> DataFrame:
    return medians(steep, [*keys, "axis", "output"], "slope").withColumnRenamed("median", "typical").drop("n")


def sensitivity(values: DataFrame, keys: Sequence[str] = (), reference: DataFrame | None = None, factor: float = 1.5) -> DataFrame:
    """Pairs whose slope is more than factor times the typical one; reference: frozen medians instead of these pairs' own."""
    steep = stash(slopes(values), "slopes")
    typical = stash(_typical(steep, keys) if reference is None else reference, "typical")
    met = looked_up(steep, typical, [*keys, "axis", "output"]).where("typical > 0").withColumn("ratio", F.col("slope") / F.col("typical")).where(F.col("ratio") > factor)
    subject = F.concat(F.lit("o"), "output", F.lit("~p"), "axis", F.lit(":slope"))
    return met.select(*keys, *_item("Sensitivity", subject, F.col("ratio") - 1, F.array("base", "perturbed")))


def offenders(pairs: DataFrame, subject: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Every observation that pairs (base, perturbed) name, once: keys, subject, id. However many, none is in an array."""
    return pairs.select(*keys, subject.alias("subject"), F.explode(F.array("base", "perturbed")).alias("id")).distinct()


def _naming(items: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """items with the NAMED least ids of their offenders (keys, subject, id) as observations."""
    k = list(keys)
    by = [*k, "subject"]
    # The limit by rank is taken on the map side first, so a task gets few rows of a group, whatever the group's size.
    place = F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    some = found.withColumn("_place", place).where(F.col("_place") <= NAMED).groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    met = items.join(some, by, "left")
    return met.withColumn("observations", F.coalesce("_ids", "observations")).select(*items.columns)


def broken_steps(values: DataFrame, increasing: bool = True) -> DataFrame:
    """Pairs with both ends finite, the relative size of their step (rel), and whether it goes against "keeps rising" (wrong)."""
    rel = F.abs(F.col("y1") - F.col("y0")) / F.greatest(F.abs("y0"), F.abs("y1"), F.lit(1.0))
    wrong = F.col("y1") < F.col("y0") if increasing else F.col("y1") > F.col("y0")
    return values.where(_both_finite()).withColumn("rel", rel).withColumn("wrong", wrong)


def _tallied(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    return steps.groupBy(*by).agg(F.count_if("wrong").alias("violated"), F.count("*").alias("total"), F.coalesce(F.max(F.when(F.col("wrong"), F.col("rel"))), F.lit(0.0)).alias("worst"))


def monotony(values: DataFrame, keys: Sequence[str] = (), increasing: bool = True) -> DataFrame:
    """For each axis and output: violated, total, worst and severity of "keeps rising" (or falling)."""
    steps = stash(broken_steps(values, increasing), "steps")  # read by three steps
    by = [*keys, "axis", "output"]
    typical = medians(steps, by, "rel").select(*by, F.col("median").alias("typical"))
    typical_wrong = medians(steps.where("wrong"), by, "rel").select(*by, F.col("median").alias("typical_wrong"))
    out = _tallied(steps, by).join(typical, by, "left").join(typical_wrong, by, "left")
    ratio = F.greatest(F.try_divide(F.col("typical_wrong"), F.col("typical")), F.lit(2.2250738585072014e-308))
    severity = F.when((F.col("typical") > 0) & F.col("typical_wrong").isNotNull(), F.abs(F.ln(ratio))).otherwise(F.lit(0.0))
    return out.withColumn("severity", severity).drop("typical", "typical_wrong")


def _declared(values: DataFrame, axis: int, output: int) -> DataFrame:
    return values.where((F.col("axis") == axis) & (F.col("output") == output))


def monotone_offenders(values: DataFrame, relation: int, axis: int, output: int, increasing: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """Every observation in a pair that breaks a declared direction: keys, subject, id."""
    return offenders(broken_steps(_declared(values, axis, output), increasing).where("wrong"), F.lit(f"check{relation}"), keys)


def monotone_check(values: DataFrame, relation: int, axis: int, output: int, increasing: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """One item if a declared direction is broken: share of broken pairs times the worst relative excursion."""
    m = _tallied(broken_steps(_declared(values, axis, output), increasing), [*keys, "axis", "output"]).where("violated > 0")
    magnitude = F.col("violated") / F.col("total") * F.col("worst")
    items = m.select(*keys, *_item("Behavioral", F.lit(f"check{relation}"), magnitude, _none())).where("magnitude > 0")
    return _naming(items, monotone_offenders(values, relation, axis, output, increasing, keys), keys)


def inferred_patterns(values: DataFrame, keys: Sequence[str] = (), integer_axes: Sequence[int] = ()) -> DataFrame:
    """Rising outputs that turn back in less than a quarter of pairs, by steps out of family in size."""
    m = monotony(values, keys).where(~F.col("axis").isin(list(integer_axes)) if integer_axes else F.lit(True))
    odd = m.where((F.col("violated") > 0) & (F.col("violated") * 4 < F.col("total")) & (F.col("worst") > 1e-6) & (F.col("severity") >= F.ln(F.lit(2.0))))
    items = odd.select(*keys, *_item("Behavioral", _pattern(), F.col("severity"), _none()))
    return _naming(items, offenders(broken_steps(values).where("wrong"), _pattern(), keys), keys)


def _pattern() -> Column:
    return F.concat(F.lit("o"), "output", F.lit("~p"), "axis", F.lit(":monotone_up"))


def _exponents(values: DataFrame, axis: int, output: int, power: float, keys: Sequence[str]) -> DataFrame:
    """Pairs with their local exponent, and the distance of the mean exponent from the declared one."""
    k = list(keys)
    mine = _declared(values, axis, output).where(F.least("x0", "x1", "y0", "y1") > 0)
    local = mine.withColumn("step", F.ln("x1") - F.ln("x0")).where(F.abs("step") >= 1e-12).withColumn("exponent", (F.ln("y1") - F.ln("y0")) / F.col("step"))
    mean = local.groupBy(*k).agg(F.abs(F.avg("exponent") - power).alias("deviation"))
    return local.join(mean, k) if k else local.crossJoin(F.broadcast(mean))  # one row


def scales_as(values: DataFrame, relation: int, axis: int, output: int, power: float, keys: Sequence[str] = ()) -> DataFrame:
    """One item on how far the mean local exponent is from the declared power, naming the pairs that show it."""
    met = _exponents(values, axis, output, power, keys)
    one = F.min(F.struct("base", "perturbed")).alias("one")
    out = met.groupBy(*keys, "deviation").agg(one).where("deviation > 0")
    items = out.select(*keys, *_item("Behavioral", F.lit(f"check{relation}"), F.col("deviation"), F.array("one.base", "one.perturbed")))
    return _naming(items, scale_offenders(values, relation, axis, output, power, keys), keys)


def scale_offenders(values: DataFrame, relation: int, axis: int, output: int, power: float, keys: Sequence[str] = ()) -> DataFrame:
    """Every observation in a pair whose exponent is at least half the mean's distance off: keys, subject, id."""
    far = F.abs(F.col("exponent") - power) >= F.col("deviation") * 0.5
    return offenders(_exponents(values, axis, output, power, keys).where(far), F.lit(f"check{relation}"), keys)


def lipschitz(values: DataFrame, relation: int, axis: int, output: int, bound: float, keys: Sequence[str] = ()) -> DataFrame:
    """One item if some slope passes the bound: the steepest by the bound."""
    steepest = slopes(_declared(values, axis, output)).groupBy(*keys).agg(F.max("slope").alias("steepest")).where(F.col("steepest") > bound)
    items = steepest.select(*keys, *_item("Behavioral", F.lit(f"check{relation}"), F.col("steepest") / bound, _none()))
    return _naming(items, steep_offenders(values, relation, axis, output, bound, keys), keys)


def steep_offenders(values: DataFrame, relation: int, axis: int, output: int, bound: float, keys: Sequence[str] = ()) -> DataFrame:
    """Every observation in a pair whose slope passes the bound: keys, subject, id."""
    return offenders(slopes(_declared(values, axis, output)).where(F.col("slope") > bound), F.lit(f"check{relation}"), keys)


def symmetric(observations: DataFrame, swaps: DataFrame, relation: int, output: int, keys: Sequence[str] = ()) -> DataFrame:
    """One item for each swap of two inputs that changed the output."""
    k = list(keys)
    a = observations.select(*k, F.col("id").alias("base"), F.get("y", F.lit(output)).alias("y0"))
    b = observations.select(*k, F.col("id").alias("swapped"), F.get("y", F.lit(output)).alias("y1"))
    met = swaps.join(a, [*k, "base"]).join(b, [*k, "swapped"]).where(_both_finite()).withColumn("far", ieee.relative(F.col("y0"), F.col("y1"))).where("far > 0")
    return met.select(*k, *_item("Behavioral", F.lit(f"check{relation}"), F.col("far"), F.array("base", "swapped")))


def drift(trace: Column) -> Column:
    """The largest relative distance from the first value; null where that is zero, not finite or missing."""
    first = F.get(trace, F.lit(0))
    far = F.array_max(F.transform(F.filter(trace, ieee.is_finite), lambda v: F.abs(v - first) / F.abs(first)))
    return F.when(first.isNotNull() & ieee.is_finite(first) & (first != 0), far)


def conserved(observations: DataFrame, relation: int, trace: int, tolerance: float = 1e-3, keys: Sequence[str] = ()) -> DataFrame:
    """One item for each run whose trace drifts past the tolerance; one without weight if no run could be measured."""
    measured = observations.select(*keys, "id", drift(F.get("traces", F.lit(trace))).alias("drift"))
    found = measured.where(F.col("drift") > tolerance)
    subject = F.lit(f"check{relation}")
    items = found.select(*keys, *_item("Behavioral", subject, F.col("drift") / max(tolerance, 1e-15), F.array("id")))
    silent = measured.groupBy(*keys).agg(F.count("drift").alias("n")).where("n = 0")
    return items.unionByName(silent.select(*keys, *_item("Behavioral", subject, F.lit(0.0), F.array().cast("array<bigint>"), F.lit(0.0))))


def ulps_over_one(a: Column, b: Column) -> Column:
    """Whether two finite doubles are more than one representable step apart (opposite signs count as far apart)."""
    # One step is at most 2^-52 of the larger magnitude and at least 2^-53, and is exact in between by halving.
    return (a != b) & ((ieee.negative(a) != ieee.negative(b)) | (F.abs(a - b) > _step(F.least(F.abs(a), F.abs(b)))))


def _step(x: Column) -> Column:
    """The distance from a positive double to the next larger one."""
    exponent = F.greatest(ieee.floor(F.log2(F.greatest(x, F.lit(2.2250738585072014e-308)))), F.lit(-1022.0))
    # log2 may round up to a whole number just below a power of two
    exponent = F.when(F.pow(F.lit(2.0), exponent) > x, F.greatest(exponent - 1, F.lit(-1022.0))).otherwise(exponent)
    return F.pow(F.lit(2.0), exponent) * F.lit(2.220446049250313e-16)


def path_gap(runs: DataFrame, others: DataFrame, channel: str = "Numerical", keys: Sequence[str] = ()) -> DataFrame:
    """Outputs of two execution paths (id, y each) that differ by more than a step, both finite.

    The numerical channel names the other run by -1 - id, which is no observation's id. The differential channel names the run alone, and adds
    a fixed item where the reference leaves the real numbers and the run does not.
    """
    k = list(keys)
    met = runs.select(*k, "id", F.col("y").alias("p")).join(others.select(*k, "id", F.col("y").alias("q")), [*k, "id"])
    rows = met.select(*k, "id", F.posexplode(F.arrays_zip("p", "q")).alias("output", "v")).select(*k, "id", "output", F.col("v.p").alias("a"), F.col("v.q").alias("b"))
    both = rows.where(ieee.is_finite(F.col("a")) & ieee.is_finite(F.col("b"))).withColumn("far", ieee.relative(F.col("a"), F.col("b"))).where((F.col("far") > 0) & ulps_over_one(F.col("a"), F.col("b")))
    if channel == "Numerical":
        return both.select(*k, *_item(channel, F.concat(F.lit("o"), "output", F.lit("~p65535:continuous")), F.col("far"), F.array("id", -1 - F.col("id"))))
    subject = F.concat(F.lit("o"), "output", F.lit(":paths"))
    lost = rows.where(ieee.is_finite(F.col("a")) & ~ieee.is_finite(F.col("b")))
    return both.select(*k, *_item(channel, subject, F.col("far"), F.array("id"))).unionByName(lost.select(*k, *_item(channel, subject, F.lit(1.0), F.array("id"), F.lit(1.0))))


def without_channels(evidence: DataFrame, channels: Sequence[str]) -> DataFrame:
    """The ablation mask: evidence of other channels."""
    return evidence.where(~F.col("channel").isin(list(channels))) if channels else evidence
