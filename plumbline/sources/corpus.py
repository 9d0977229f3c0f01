"""Corpora of models with ground truth, predicates, and what campaigns measure against them."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.lang import lanes, scalar
from plumbline.lang.model import Model, from_text
from plumbline.lang.syntax import Expr, ModelError, Parser

from plumbline.operators.regions import LOCALISED
from plumbline.plans.campaign import Campaign, config_of
from plumbline.plans.partition import SUSPICIOUS, extent

SCHEMAS = ("1", "2", "3")
KNOWN = {
    "schema", "fault", "method", "derivation", "difficulty", "control", "mutant_of", "static", "narrow", "curved", "degenerate", "expect", "matched_to", "regions", "boundaries", "choice_claims",
    "meaning", "variables", "mechanism", "channels", "resolvable", "resolvability", "source", "why",
}
LATTICE = 32


def parse_predicate(text: str) -> Expr:
    p = Parser(text)
    e = p.expr()
    if p.now.kind != "end" or p.problems:
        raise ModelError(p.problems or [(p.now.line, "the predicate does not end here")])
    return e


_ARITHMETIC = {"+": "+", "-": "-", "*": "*"}


def predicate(text: str) -> Callable[[dict[str, float]], bool]:
    """The predicate over named values; false where it is undefined."""
    e = parse_predicate(text)

    def value(e: Expr, at: dict[str, float]) -> float:
        if e.op == "num":
            return e.args[0]
        if e.op == "name":
            return at[e.args[0]]
        if e.op == "neg":
            return -value(e.args[0], at)
        a, b = (value(x, at) for x in e.args)
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: scalar.div(a, b), "^": lambda: scalar.power(a, b)}[e.op]()

    def holds(e: Expr, at: dict[str, float]) -> bool | None:
        """None: undefined."""
        if e.op in ("and", "or", "not"):
            parts = [holds(x, at) for x in e.args]
            if None in parts:
                return None
            return all(parts) if e.op == "and" else any(parts) if e.op == "or" else not parts[0]
        a, b = (value(x, at) for x in e.args)
        if a != a or b != b:
            return None
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[e.op]

    return lambda at: bool(holds(e, at))


def predicate_column(text: str, names: list[str]) -> Column:
    """The same over x, an array in the order of names."""
    e = parse_predicate(text)

    def value(e: Expr) -> Column:
        if e.op == "num":
            return F.lit(e.args[0])
        if e.op == "name":
            return F.get("x", F.lit(names.index(e.args[0])))
        parts = [value(x) for x in e.args]
        if e.op == "neg":
            return -parts[0]
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.div, "^": F.pow}[e.op](*parts)

    def holds(e: Expr) -> Column:
        if e.op in ("and", "or", "not"):
            parts = [holds(x) for x in e.args]
            if e.op == "not":
                return ~parts[0]
            both = parts[0] & parts[1] if e.op == "and" else parts[0] | parts[1]
            return F.when(parts[0].isNotNull() & parts[1].isNotNull(), both)  # undefined if a part is
        a, b = map(value, e.args)
        known = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[e.op]
        return F.when(~F.isnan(a) & ~F.isnan(b), known)

    return F.coalesce(holds(e), F.lit(False))


@dataclass
class Region:
    axes: dict[str, tuple[float, float]]
    where: str | None = None
    reason: str = ""

    def box(self, m: Model) -> list[tuple[float, float]]:
        """Bounds on every axis of the model, clipped to its domain."""
        out = []
        for a in m.params:
            lo, hi = extent(a)
            p, q = self.axes.get(a.name, (lo, hi))
            out.append((max(lo, p), min(hi, q)))
        return out

    def holds(self, m: Model) -> Callable[[list[float]], bool]:
        box, where = self.box(m), predicate(self.where) if self.where else None
        names = [a.name for a in m.params]
        return lambda x: all(lo <= v <= hi for v, (lo, hi) in zip(x, box, strict=True)) and (where is None or where(dict(zip(names, x, strict=True))))


@dataclass
class Truth:
    regions: list[Region]
    boundaries: list[dict]
    control: bool = False
    static: bool = False

    @staticmethod
    def read(text: str) -> Truth:
        d = json.loads(text)
        if unknown := set(d) - KNOWN:
            raise ValueError(f"unknown fields: {sorted(unknown)}")
        if not str(d.get("schema", "")).rpartition("/")[2] in SCHEMAS:
            raise ValueError(f"unknown schema {d.get('schema')!r}")
        regions = [Region({k: tuple(v) for k, v in r["axes"].items()}, r.get("where"), r.get("reason", "")) for r in d.get("regions", [])]
        return Truth(regions, d.get("boundaries", []), d.get("control", False), d.get("static", False))


def lattice(box: list[tuple[float, float]], per_axis: int) -> np.ndarray:
    """Midpoints of slices of a box."""
    grids = np.meshgrid(*[lo + (hi - lo) * (np.arange(per_axis) + 0.5) / per_axis for lo, hi in box], indexing="ij")
    return np.stack([g.ravel() for g in grids], axis=1)


def share(region: Region, m: Model, box: list[tuple[float, float]], per_axis: int = LATTICE) -> float:
    """The share of a box inside a region: exact for a plain box, by a lattice of midpoints under a predicate."""
    out = 1.0
    common = []
    for (lo, hi), (p, q) in zip(box, region.box(m), strict=True):
        a, b = max(lo, p), min(hi, q)
        if b <= a or hi <= lo:
            return 0.0
        common.append((a, b))
        out *= (b - a) / (hi - lo)
    if region.where:
        inside = region.holds(m)
        points = lattice(common, max(4, round(4096 ** (1 / len(box)))) if len(box) > 2 else per_axis)
        out *= sum(inside(x.tolist()) for x in points) / len(points)
    return out


def outcome(entry: str, c: Campaign, truth: Truth) -> dict:
    """What a campaign found of what is true."""
    bad = [i for i in c.space.leaves if c.space.label[i] == SUSPICIOUS]
    boxes, sizes = [c.space.box(i) for i in bad], c.space.volume[bad].tolist()
    shares = [[share(r, c.m, x) for x in boxes] for r in truth.regions]
    touched = [any(all(hi >= p and lo <= q for (lo, hi), (p, q) in zip(x, r.box(c.m), strict=True)) for x in boxes) for r in truth.regions]
    inside = [r.holds(c.m) for r in truth.regions]
    first = next((k for k, o in enumerate(c.records) if any(f(o.x) for f in inside)), None)
    volume = sum(sizes)
    best = [max((s[k] for s in shares), default=0.0) for k in range(len(bad))]
    names = [a.name for a in c.m.params]
    values = [(names[e["axis"]], v) for e in c.space.edges() for v in (e["facing_lo"], e["facing_hi"], (e["facing_lo"] + e["facing_hi"]) / 2)]
    hits = sum(any(axis == b["axis"] and abs(v - b["at"]) <= b["tolerance"] for axis, v in values) for b in truth.boundaries)
    return {
        "entry": entry, "strategy": c.c.strategy, "seed": c.c.seed, "budget": c.c.budget, "evaluations": c.evaluations, "steps": c.steps, "declared_regions": len(truth.regions), "detected_regions": sum(touched),
        "localised_regions": sum(t and max(s, default=0.0) >= LOCALISED for t, s in zip(touched, shares, strict=True)), "findings": len(c.findings), "leaf_cells": len(c.space.leaves), "first_true_failure": first, "first_flagged": c.first_flagged,
        **c.space.shares(), "false_positive": 1 - sum(v * s for v, s in zip(sizes, best, strict=True)) / volume if volume and truth.regions else 0.0 if truth.control and not volume else None,
        "boundaries": len(truth.boundaries), "boundary_hits": hits,
    }


OUTCOME = "entry string, strategy string, seed long, budget long, evaluations long, steps long, declared_regions long, detected_regions long, localised_regions long, findings long, leaf_cells long, first_true_failure long, first_flagged long, trusted double, suspicious double, unknown double, provisional double, false_positive double, boundaries long, boundary_hits long"


def sweep(campaigns: DataFrame) -> DataFrame:
    """Rows (entry, model, truth, config) run and measured: the outcomes that the metrics operators read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for entry, text, truth, config in f[["entry", "model", "truth", "config"]].itertuples(index=False):
                c = Campaign(from_text(text), config_of(config)).run()
                rows.append(outcome(entry, c, Truth.read(truth)))
            made = pd.DataFrame(rows)
            for name in ("first_true_failure", "first_flagged"):
                made[name] = made[name].astype("Int64")
            yield made

    return campaigns.select("entry", "model", "truth", "config").mapInPandas(run, OUTCOME)


def registry(spark: SparkSession, root: str) -> DataFrame:
    """(entry, model, truth) texts of every <family>/<name>/model.ap with its truth.json below root."""
    texts = lambda name: spark.read.option("wholetext", True).text(f"{root}/*/*/{name}").select(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)/[^/]+$", 1).alias("entry"), "value")
    return texts("model.ap").withColumnRenamed("value", "model").join(texts("truth.json").withColumnRenamed("value", "truth"), "entry")


def verify(m: Model, truth: Truth, per_axis: int = 0) -> dict:
    """Ground truth against a dense grid: shares of inside points that fail and of clearly outside ones that do not."""
    n = per_axis or max(4, round(4096 ** (1 / len(m.params))))
    axes = [np.array(a.choices) if a.discrete else np.linspace(a.lo, a.hi, n) for a in m.params]
    x = np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")], axis=1)
    r = lanes.evaluate(m, x)
    run = scalar.compiled(m)
    from plumbline.plans.readings import Observation, pointwise

    fails = np.array([bool(pointwise(m, Observation(i, p.tolist(), q.y, q.traces, q.flags, q.steps, q.rules))) for i, p in enumerate(x) for q in (run(p.tolist()),)])
    inside_of = [reg.holds(m) for reg in truth.regions]
    inside = np.array([any(f(p.tolist()) for f in inside_of) for p in x])
    width = [hi - lo for lo, hi in map(extent, m.params)]

    def margin(p: np.ndarray) -> float:
        return min((sum(max(lo - v, v - hi, 0.0) / w for v, (lo, hi), w in zip(p, reg.box(m), width, strict=True)) for reg in truth.regions), default=1.0)

    clear = np.array([not i and margin(p) > 0.02 for i, p in zip(inside, x, strict=True)])
    ok_in = float(fails[inside].mean()) if inside.any() else 1.0
    ok_out = float((~fails[clear]).mean()) if clear.any() else 1.0
    return {"inside": int(inside.sum()), "inside_failing": ok_in, "outside_clean": ok_out, "good": ok_in >= 0.99 and ok_out >= 0.9, "points": len(r.y)}
