"""The engine: language, evaluators, evidence, atlas, campaigns, truth, archives, streams."""

import contextlib
import io
import json
import math
import random
import re
import sys
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.lang import columns, lanes, scalar, units
from plumbline.lang.model import compile_model, from_text, to_text
from plumbline.lang.syntax import ModelError
from plumbline.operators import atlas, calibrate, compare, evidence, metrics, minimal, regions
from plumbline.plans import campaign, model_queries, partition, readings, search
from plumbline.plans.campaign import Campaign, Config
from plumbline.sources import archive, corpus, program, sample
from plumbline.sources.sample import Axis
from plumbline.streaming import risk

FLAT = """model flat "every function" {
  input a in [-3, 3]
  input b in [-2, 2]
  input n : count in [0, 5]
  let q = a / b + a % b
  let p = pow(abs(a), b) + sqrt(a) + cbrt(a) + exp(b) + ln(a) + log2(abs(b)) + log10(abs(a))
  let t = sin(a) + cos(b) + tan(a) + asin(b) + acos(b) + atan(a) + atan2(a, b) + sinh(a) + cosh(b) + tanh(a)
  let r = floor(a) + ceil(b) + round(a) + trunc(b) + min(a, b) + max(a, b) + hypot(a, b) + clamp(a, -1, 1) + lerp(a, b, 0.25)
  let w = n * 2.5 - a^2
  require q <= 4 and t > -10
  require finite(p)
  require r ~ 1
}"""
LOOPS = """model spring {
  input dt in [0.01, 0.3]   # a step
  input k : count in [0, 12]
  state x = 1.0
  state v = 0.0
  loop k {
    let before = x
    advance x = x + v * dt
    advance v = v - before * dt
    watch x
  }
  let energy = 0.5 * (x * x + v * v)
  require energy < 0.6
  check conserved(x, 0.5)
  check monotone_up(energy wrt dt)
}"""
CIRCLE = "model circle { input px in [-1, 3] input py in [-1, 3] let r = (px - 1) * (px - 1) + (py - 1) * (py - 1) require r <= 4 }"
CIRCLE_TRUTH = json.dumps({"schema": "x/2", "regions": [{"axes": {"px": [-1, 3], "py": [-1, 3]}, "where": "(px - 1) * (px - 1) + (py - 1) * (py - 1) > 4"}], "boundaries": [{"axis": "px", "at": 3, "tolerance": 0.3}]})
ROOT_MODEL = "model root { input x in [-10, 10] let y = sqrt(x) require finite(y) }"


def points_of(model, n=200, seed=1):
    rng = np.random.default_rng(seed)
    return np.array([[rng.integers(a.lo, a.hi + 1) if a.integer else rng.choice([a.lo, 0.0, a.hi, rng.uniform(a.lo, a.hi)]) for a in model.params] for _ in range(n)], float)


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("text", [FLAT, LOOPS])
def test_lanes_agree_with_scalar(text, single):
    m = compile_model(text)
    x = points_of(m)
    r, run = lanes.evaluate(m, x, single), scalar.compiled(m, single)
    for i in range(len(x)):
        p = run(x[i].tolist())
        assert np.allclose(p.y, r.y[i], rtol=1e-5 if single else 1e-12, equal_nan=True) and (p.flags, p.steps) == (r.flags[i], r.steps[i])
        assert [len(t) for t in p.traces] == [len(t[i]) for t in r.traces]
        assert np.allclose(np.array(p.rules), r.rules[:, :, i], rtol=1e-5 if single else 1e-12, equal_nan=True)


def test_columns_agree_with_scalar(spark):
    text = FLAT.replace("input n : count in [0, 5]", "input n in [0, 5]")
    m = compile_model(text)
    assert columns.expressible(m) and not columns.expressible(compile_model(LOOPS))
    x = points_of(m)
    run = scalar.compiled(m)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = {r.id: r for r in columns.run_model(df, m).collect()}
    for i in range(len(x)):
        p = run(x[i].tolist())
        assert np.allclose(p.y, got[i].y, rtol=1e-9, equal_nan=True) and p.flags == got[i].flags, (x[i], p, got[i])
    wide = {r.id: r for r in lanes.run_model(df, m).collect()}
    assert all(np.allclose(wide[i].y, got[i].y, rtol=1e-9, equal_nan=True) for i in wide)
    items = evidence.constraints(columns.run_model(df, m), columns.rules_of(m)).count()
    assert items == sum(len([e for e in readings.pointwise(m, readings.Observation(i, v.tolist(), q.y, q.traces, q.flags, q.steps, q.rules)) if "require" in e.subject]) for i, v in enumerate(x) for q in (run(v.tolist()),))


def test_columns_stay_in_methods_that_the_jvm_compiles(spark):
    steps = ("{v} * q + 1", "sqrt({v}) / (d - 0.5)", "floor({v} % 7)", "round({v} * d)", "clamp({v}, d, n) - trunc({v} / 3)", "max({v}, d) + ln({v})")
    lets = " ".join(f"let v{k} = {steps[k % len(steps)].format(v=f'v{k - 1}')}" for k in range(1, 13))
    long = f"model long {{ input q in [-60, 60] input d in [0, 1] input n : count in [0, 5] let v0 = q {lets} require v3 < 30 }}"
    for text in (model_queries.PRICE, long):
        m = compile_model(text)
        at = spark.range(50).select("id", F.array((F.col("id") - 25).cast("double"), (F.col("id") % 3) / 4, (F.col("id") % 5).cast("double")).alias("x"))
        made = columns.run_model(at, m)
        told = io.StringIO()
        with contextlib.redirect_stdout(told):
            made.explain("codegen")
        sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
        assert sizes and max(sizes) < 8000, sizes
        run = scalar.compiled(m)
        for r in made.collect():
            p = run(r.x[: len(m.params)])
            assert np.allclose(p.y, r.y, rtol=1e-9, equal_nan=True) and np.allclose(p.rules, r.rules, rtol=1e-9, equal_nan=True) and (p.flags, p.steps) == (r.flags, r.steps), (p, r)


def test_columns_of_points_with_nulls_raise_what_their_other_results_raise(spark):
    m = compile_model("model m { input a in [0, 1] input b in [0, 1] let s = a + 1 let t = 1 / b let u = sqrt(b) }")
    df = spark.createDataFrame([(0, [None, 1.0]), (1, [None, 0.0]), (2, [None, -1.0]), (3, [math.nan, None])], "id long, x array<double>")
    got = {r.id: (r.y[0], r.flags) for r in columns.run_model(df, m).collect()}
    assert [got[i] for i in range(3)] == [(None, 0), (None, 6), (None, 9)] and math.isnan(got[3][0]) and got[3][1] == 1


def test_reference_path_is_more_exact():
    m = compile_model("model c { input a in [1, 2] let y = (a + 1e16) - 1e16 - a }")
    x = np.array([[1.25], [1.75]])
    assert (lanes.evaluate(m, x).y[:, 0] != 0).all() and (lanes.reference(m, x).y[:, 0] == 0).all()
    z = (np.array([2.0]), np.array([0.0]))
    root = lanes.dd_sqrt(z)
    assert abs(lanes.dd_add(lanes.dd_mul(root, root), (-z[0], z[1]))[0][0]) < 1e-30


def test_text_round_trip_and_step_budget():
    for text in (FLAT, LOOPS, CIRCLE):
        m = compile_model(text)
        assert to_text(from_text(to_text(m))) == to_text(m)
    m = compile_model(LOOPS)
    p = scalar.compiled(m, max_steps=10)([0.1, 12.0])
    assert p.flags & 32 and p.steps == 11 and lanes.evaluate(m, np.array([[0.1, 12.0]]), max_steps=10).flags[0] & 32


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("model m { input x in [2, 1] }", "empty"), ("model m { input x in [0, inf] }", "no bound"), ("model m { input x in {1} }", "two choices"), ("model m { input x : m in [0, 1] input t : s in [0, 1] let y = x + t }", "different quantities"),
        ("model m { input x : degC in [0, 1] }", "kelvin"), ("model m { input x : parsec in [0, 1] }", "no known unit"), ("model m { input x : m in [0, 1] let y = exp(x) }", "pure number"), ("model m { input x in [0, 1] require x > 0 or x < 1 }", "or cannot"),
        ("model m { input x in [0, 1] require x != 0 }", "!="), ("model m { input x in [0, 1] let y = z }", "not known"), ("model m { input x in [0, 1] check flat(x) }", "no relation"), ("model m { input x in [0, 1] let y = sqrt(x, x) }", "takes 1"),
        ("model m { input x in [0, 1] loop 2.5 { } }", "whole number"), ("model m { input x in [0, 1] /* open", "not closed"), ("model m { input x in [0, 1] let x = 1 }", "already"), ("model m { input π in [0, 1] }", "no meaning"), ("model m { input x in [0, 1] check conserved(x) }", "not watched"),
        ("model m { input x : m in [0, 1] let y = sqrt(x * x * x) + cbrt(x) }", "cbrt"), ("model m { }", "no input"),
    ],
)
def test_models_that_are_refused(text, said):
    with pytest.raises(ModelError, match=said.replace("!", "!")):
        compile_model(text)


def test_units():
    m = compile_model("model m { input x : km in [0, 1] input y : m in [0, 1] input t : s in [1, 2] let v = x / t let z = x + y let r = sqrt(v * v) + v require v > 3 }")
    assert len(m.warnings) == 1 and "mixes scales" in m.warnings[0]
    assert units.dim_text(units.UNITS["V"].dim) == "m^2*kg/s^3/A"


def test_two_errors_are_both_told():
    with pytest.raises(ModelError) as e:
        compile_model("model m {\n input x in [0 1]\n let y = )\n let z = 1 }")
    assert [n for n, _ in e.value.problems] == [2, 3]


def test_ieee_columns(spark):
    nan, inf = math.nan, math.inf
    values = [0.0, -0.0, 1.0, -1.5, 2.5, -2.5, nan, inf, -inf, 1e300, 0.5, -0.5]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    a, b = F.col("a"), F.col("b")
    made = df.select("a", "b", ieee.div(a, b).alias("div"), ieee.rem(a, b).alias("rem"), ieee.fmin(a, b).alias("lo"), ieee.fmax(a, b).alias("hi"), ieee.floor(a).alias("floor"), ieee.ceil(a).alias("ceil"), ieee.trunc(a).alias("trunc"), ieee.round_half_away(a).alias("round"), ieee.ln(a).alias("ln"), ieee.lt(a, b).alias("lt"), ieee.eq(a, b).alias("eq"))
    same = lambda p, q: (p != p and q != q) or (p == q and math.copysign(1, p) == math.copysign(1, q))
    for r in made.collect():
        assert same(r["div"], scalar.div(r.a, r.b)) and (same(r.rem, scalar.rem(r.a, r.b)) or math.isinf(r.b))
        assert r.lo == scalar.lower(r.a, r.b) or r.a != r.a and r.b != r.b
        assert r.hi == scalar.higher(r.a, r.b) or r.a != r.a and r.b != r.b
        for name in ("floor", "ceil", "trunc", "round"):
            assert same(r[name], scalar.CALLS[name](r.a)), (name, r.a, r[name])
        assert same(r.ln, scalar.CALLS["ln"](r.a)) and r["lt"] == (r.a < r.b) and r.eq == (r.a == r.b)


def test_generators(spark):
    axes = [Axis("a", -1.0, 2.0), Axis("c", choices=(1.0, 4.0, 9.0))]
    rows = search.halton_rows(1, 300, 2)
    for r in sample.halton(spark, 50, axes).orderBy("id").collect():
        assert r.x == pytest.approx(campaign.from_unit(rows[r.id], axes))
    s = sample.Stream(7)
    drawn = [s() for _ in range(20)]
    u = {r.id: r.x for r in sample.uniform(spark, 10, [Axis("u"), Axis("v")], 7).repartition(3).collect()}
    assert [v for i in range(10) for v in u[i]] == drawn and all(0 <= v < 1 for v in drawn)
    assert sample.grid(spark, 3, axes).count() == 9 and sample.label_seed("a") == 0xAF63DC4C8601EC8C
    star = sample.probe_star(spark.createDataFrame([(1, [2.0, 1.0])], "id long, x array<double>"), axes).collect()
    assert sorted((r.axis, *r.x) for r in star) == [(0, 2.0 - 3e-4, 1.0), (1, 2.0, 4.0)]


def test_dataframe_atlas_agrees_with_the_search(spark):
    """The retrospective atlas of DataFrames and the one of the search file and split alike."""
    rnd = random.Random(3)
    marks = [(i, [rnd.uniform(0, 1), rnd.uniform(0, 1)], 0.9 if rnd.random() < 0.1 else rnd.random() * 0.3) for i in range(400)]
    marks = [(i, x, risk, 2, risk > 0.8 and x[0] > 0.6, 18) for i, x, risk in marks]
    m = compile_model("model m { input a in [0, 1] input b in [0, 1] }")
    mine = partition.Partition(m.params, atlas.Policy(max_depth=5))
    _, x, risk, speaking, fact, reading = zip(*marks, strict=True)
    mine.refill(x, risk, speaking, reading, fact)
    while mine.divide():
        pass
    one_by_one = partition.Partition(m.params, atlas.Policy(max_depth=5))
    for _, *p in marks:
        one_by_one.add(p[0], p[1], p[2], p[4], p[3])
    one_by_one.judge()
    while one_by_one.divide():
        pass
    assert one_by_one.table() == mine.table()
    df = spark.createDataFrame(marks, "id long, x array<double>, risk double, channels int, fact boolean, measured int")
    cells, _ = atlas.build(df, ([0.0, 0.0], [1.0, 1.0]), policy=atlas.Policy(max_depth=5))
    got = {(tuple(r.lo), tuple(r.hi)): (r.label, r.samples) for r in cells.collect()}
    want = {(tuple(c["lo"]), tuple(c["hi"])): (c["label"], c["samples"]) for c in mine.table()}
    assert got == want and len(want) > 10
    cover = atlas.coverage(cells, ([0.0, 0.0], [1.0, 1.0])).first()
    assert cover.trusted == pytest.approx(mine.shares()["trusted"])
    bands = sorted((r.axis, r.lo, r.hi, r.transitions) for r in atlas.merge_bands(atlas.raw_bands(cells, 2)).collect())
    assert bands == sorted((b["axis"], b["lo"], b["hi"], b["transitions"]) for b in mine.edges())


def test_fusion_agrees_with_the_search(spark):
    rnd = random.Random(5)
    sets = {k: [readings.Item(rnd.choice(evidence.CHANNELS), f"s{rnd.randrange(3)}", 10 ** rnd.uniform(-3, 1), rnd.sample(range(6), rnd.randint(1, 3)), 1.0 if fixed else 0.0, fixed) for _ in range(rnd.randint(1, 6)) for fixed in (rnd.random() < 0.3,)] for k in range(40)}
    rows = [(k, e.channel, e.subject, e.magnitude, e.strength, e.observations, e.fixed) for k, s in sets.items() for e in s]
    df = spark.createDataFrame(rows, "k long, channel string, subject string, magnitude double, strength double, observations array<bigint>, fixed boolean")
    scales = readings.Scales(list(sets.values()))
    done = {k: scales.apply(s) for k, s in sets.items()}
    cal = calibrate.calibrated(df, calibrate.channel_scale(df), calibrate.claim_scale(df))
    rho = readings.correlation(list(done.values()))
    got_rho = {(r.a, r.b): r.rho for r in calibrate.channel_correlation(calibrate.strongest(cal, ["k"])).collect()}
    assert all(got_rho[p] == pytest.approx(rho[p]) for p in got_rho)
    risk_of = {r.k: r.score for r in calibrate.fused(cal, ["k"], calibrate.channel_correlation(calibrate.strongest(cal, ["k"]))).collect()}
    for k, s in done.items():
        assert risk_of.get(k, 0.0) == pytest.approx(readings.fuse(s, rho))


@pytest.mark.parametrize("strategy", list(search.STRATEGIES))
def test_campaigns(strategy):
    m = compile_model(CIRCLE)
    config = Config(strategy, seed=5, budget=300)
    c, again = Campaign(m, config).run(), Campaign(m, config).run()
    assert c.evaluations == 300 and campaign.summary("c", c) == campaign.summary("c", again)
    assert all(-1 - 1e-9 <= v <= 3 + 1e-9 for o in c.records for v in o.x) and sum(c.space.shares().values()) == pytest.approx(1)
    assert c.findings and all(c.space.label[f["cell"]] == partition.SUSPICIOUS for f in c.findings)
    out = corpus.outcome("circle", c, corpus.Truth.read(CIRCLE_TRUTH))
    assert out["detected_regions"] == 1 and 0 <= out["false_positive"] < 0.5


def test_sweep_and_ladder(spark):
    m = compile_model(CIRCLE)
    jobs = [("circle", text, CIRCLE_TRUTH, config) for _, text, config in campaign.plan({"circle": m}, ["adaptive", "random"], [1, 2], [60, 200])]
    out = corpus.sweep(spark.createDataFrame(jobs, "entry string, model string, truth string, config string").repartition(4))
    rows = metrics.ladder(out).collect()
    assert len(rows) == 4 and all(r.detected_at in (60, 200) for r in rows)
    assert metrics.verdict(metrics.ladder(out)).count() == 2


def test_truth():
    m = compile_model(CIRCLE)
    t = corpus.Truth.read(CIRCLE_TRUTH)
    assert corpus.verify(m, t)["good"]
    assert corpus.share(t.regions[0], m, [(-1, 3), (-1, 3)]) == pytest.approx(1 - math.pi / 4, abs=0.01)
    assert not corpus.predicate("1 / x > 0 or x < 9")({"x": math.nan}) and corpus.predicate("not (x > 1) and 2 * x >= -4")({"x": 0.5})
    with pytest.raises(ValueError, match="unknown fields"):
        corpus.Truth.read('{"schema": "x/2", "color": 1}')


def test_predicate_columns(spark):
    text = "x * x - y < 1 and (y / x > 0 or not x == 2)"
    rows = [(i, [a, b]) for i, (a, b) in enumerate((a, b) for a in (-1.0, 0.0, 0.5, 2.0) for b in (-1.0, 0.0, 3.0))]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    got = {r.id: r.h for r in df.select("id", corpus.predicate_column(text, ["x", "y"]).alias("h")).collect()}
    assert got == {i: corpus.predicate(text)({"x": x[0], "y": x[1]}) for i, x in rows}


def test_minimal_cases(spark):
    """Inputs that have nothing to do with a failure are free; the others go as far as the failure does."""
    m = compile_model("model m { input a in [0, 10] input b in [0, 10] input c in {1, 2, 3} let y = a * c require y <= 12 }")
    df = spark.createDataFrame([(0, [7.123456, 3.3, 3.0]), (1, [9.9, 0.1, 2.0]), (2, [1.0, 1.0, 1.0])], "id int, x array<double>")
    got = {r.id: r for r in minimal.edges(minimal.reduced(df, m, (5.0, 5.0, 1.0)), m).collect()}
    assert [got[i].verified for i in range(3)] == [True, True, False]
    assert got[0].free == [0, 1] and got[0].core == [5.0, 5.0, 3.0]  # five times three is too much as well
    assert got[1].free == [1] and got[1].lo[0] == pytest.approx(6.0) and got[1].hi == [10.0, 10.0, 2.0] and got[1].lo[1:] == [0.0, 2.0]
    assert got[2].core == [1.0, 1.0, 1.0] and got[2].free == []
    # What breaks a rule by itself stays, whatever the others do.
    late = compile_model("model l { input a in [0, 1] input b in [0, 1] let y = max(a - b, 0 - a - b) let z = b require y <= 0.4 and z <= 0.9 }")
    again = minimal.reduced(spark.createDataFrame([(0, [0.9, 0.95])], "id int, x array<double>"), late, (0.0, 0.0)).first()
    assert again.verified and 0 in again.free and again.core[1] == 0.95
    assert minimal.reduced(df.limit(0), m, (5.0, 5.0, 1.0)).count() == 0


def test_archive(spark, tmp_path):
    c = Campaign(compile_model(LOOPS), Config(budget=120)).run()
    d = Campaign(compile_model(LOOPS), Config(budget=120, seed=9)).run()
    for name, x in (("a", c), ("b", c), ("d", d)):
        archive.write(spark, x, str(tmp_path / name))
    a, b, other = (archive.Archive(spark, str(tmp_path / n)) for n in ("a", "b", "d"))
    assert a.damaged() == [] and a.replay().count() == 0
    assert compare.verdict(archive.compared(spark, a, b)).first()[0] == "identical"
    assert compare.verdict(archive.compared(spark, a, other)).first()[0] == "differing"
    a.tables["bands"] = a.tables["bands"].limit(0) if a.tables["bands"].count() else a.tables["bands"].union(spark.createDataFrame([(0, 1.0, 2.0, 1.0, 2.0, 1)], archive.TABLES["bands"]))
    assert a.damaged() == ["bands"]
    with pytest.raises(Exception, match="exist"):
        archive.write(spark, c, str(tmp_path / "a"))


def test_program(spark, tmp_path):
    script = tmp_path / "beam.py"
    script.write_text("import sys, json, time\nfor line in sys.stdin:\n    x = json.loads(line)['x'][0]\n    if x == 3: print(json.dumps({'error': 'no'}), flush=True)\n    elif x == 4: time.sleep(5)\n    elif x == 5: print('nonsense', flush=True)\n    elif x == 6: sys.exit()\n    else: print(json.dumps({'y': [2 * x], 'steps': 7}), flush=True)\n")
    df = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "id long, x array<double>").coalesce(1)
    got = {r.id: r for r in program.run_program(df, f"{sys.executable} {script}", 1, timeout=2.0).collect()}
    assert [got[i].y[0] for i in (0, 1, 2, 7, 8)] == [0, 2, 4, 14, 16] and got[1].steps == 7
    assert [bool(got[i].error) and got[i].flags == 1 for i in (3, 4, 5, 6)] == [True] * 4
    assert all(got[i].y[0] != got[i].y[0] for i in (3, 4, 5, 6))  # NaN, not null


def test_regions(spark):
    cells = spark.createDataFrame([(0, [0.0, 0.0], [2.0, 2.0], "SUSPICIOUS"), (1, [2.0, 0.0], [4.0, 2.0], "TRUSTED")], "cell int, lo array<double>, hi array<double>, label string")
    boxes = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 2.0]), (1, [0.5, 0.0], [1.5, 1.0]), (2, [3.9, 0.0], [9.0, 9.0])], "region int, lo array<double>, hi array<double>")
    got = {r.cell: r.overlap for r in regions.union_overlap(cells, boxes, axes=2).collect()}
    assert got == {0: pytest.approx(2.5 / 4), 1: pytest.approx(0.05)}
    assert {r.region for r in regions.detected(boxes, cells).collect()} == {0, 1}
    found = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.4), (2, 1, 0.5), (3, 0, 0.1)], "finding int, region int, overlap double")
    assert regions.duplicate_rate(found).first()[0] == pytest.approx(1 / 3)


def test_json_and_sets(spark):
    a = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": null}'), (2, "no json"), (3, None)], "id long, doc string")
    assert sorted(tuple(r) for r in compare.json_paths(a, "doc", ["id"]).collect()) == [(1, "a.b[0]", "1"), (1, "a.b[1]", "2"), (1, "c", "null")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", F.col("event_type").alias("key"), (F.col("value") / 500).alias("risk"))
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for name, df, mode in (("w", risk.windows(stream, late="60 days"), "update"), ("s", risk.cell_states(stream), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    batch = {(r.start, r.key): r.samples for r in risk.windows(rows).collect()}
    last = {}
    for r in spark.sql("select * from w").collect():
        last[r.start, r.key] = max(last.get((r.start, r.key), 0), r.samples)
    assert last == batch
    totals = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    assert {r.key: r.samples for r in spark.sql("select key, max(samples) as samples from s group by key").collect()} == totals


def test_driver_queries_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__
    from plumbline.plans import queries

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    assert __spark_entry__.entry(spark).count() > 0 and set(queries.QUERIES) <= set(__spark_entry__.queries())
    show = lambda v: "NULL" if v is None or v != v else f"{float(v):.6g}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        cols = sorted(df.columns)
        got = sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols, name
        assert got == sorted(tuple(show(r[names.index(c)]) for c in cols) for r in rel.fetchall()), name


def test_medians(spark):
    from statistics import median

    from plumbline.functions.median import medians

    rnd = random.Random(2)
    rows = [(k, v) for k, n in ((None, 1), ("a", 2), ("b", 3), ("c", 20_001), ("d", 6000)) for v in ([rnd.gauss(0, 1) for _ in range(n)] if k != "d" else [float(rnd.randrange(3)) for _ in range(n)])]
    got = {r.k: (r.median, r.n) for r in medians(spark.createDataFrame([*rows, ("e", None)], "k string, v double"), ["k"], "v").collect()}
    assert got == {k: (pytest.approx(median([v for q, v in rows if q == k])), sum(q == k for q, _ in rows)) for k in {k for k, _ in rows}}
    assert medians(spark.createDataFrame(rows, "k string, v double"), [], "v").first().n == len(rows)
