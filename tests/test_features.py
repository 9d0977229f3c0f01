"""Executors, protocols, fronts, location, streams' labels, arms and comparisons."""

import json
import math
import random

import numpy as np
import pytest

from plumbline.lang import executors, lanes
from plumbline.lang.model import compile_model
from plumbline.operators import atlas, calibrate, compare, evidence, metrics, regions
from plumbline.plans import campaign, partition, readings, search
from plumbline.sources import protocol

FLAT = "model f { input a in [-2, 2] input b in [0, 1] let s = a * b + 1 let t = fma(a, b, 1) / (a - 1) require s < 2 }"


def test_executors_agree(spark):
    m = compile_model(FLAT)
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, [rnd.choice([1.0, rnd.uniform(-2, 2)]), rnd.random()]) for i in range(60)], "id long, x array<double>")
    wide = {r.id: r for r in executors.execute(df, m, "lanes").collect()}
    one = {r.id: r for r in executors.execute(df, m, "scalar").collect()}
    for i in wide:
        assert np.allclose(wide[i].y, one[i].y, equal_nan=True) and (wide[i].flags, wide[i].steps) == (one[i].flags, one[i].steps) and np.allclose(wide[i].rules, one[i].rules)
    with pytest.raises(ValueError, match="no Columns"):
        executors.execute(df, m, "columns")


def test_fma_rounds_once():
    rng = np.random.default_rng(1)
    a, b = (rng.standard_normal(5000) * 10.0 ** rng.integers(-30, 30, 5000) for _ in range(2))
    c = -a * b * (1 + rng.integers(-3, 4, 5000) * 2.0**-52)
    assert (lanes._fma(a, b, c) == [math.fma(x, y, z) for x, y, z in zip(a, b, c, strict=True)]).all()


def test_equal_points_are_located_each(spark):
    cells = spark.createDataFrame([(0, 0, [0.0], [1.0]), (1, 1, [1.0], [2.0])], "cell int, seq int, lo array<double>, hi array<double>")
    points = spark.createDataFrame([(7, [0.5]), (7, [0.5]), (8, [1.0]), (9, [3.0]), (10, [math.nan])], "id long, x array<double>")
    assert sorted((r.id, -1 if r.cell is None else r.cell) for r in atlas.locate(points, cells).collect()) == [(7, 0), (7, 0), (8, 0), (9, -1), (10, -1)]


@pytest.mark.parametrize("columns", [2, 3])
def test_pareto_front(spark, columns):
    rnd = random.Random(4)
    rows = [tuple(float(rnd.randrange(12)) for _ in range(columns)) for _ in range(400)]
    rows += rows[:20] + [(None,) * columns]
    names = ["a", "b", "c"][:columns]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(5)
    over = lambda p, q: all(x >= y for x, y in zip(p, q, strict=True)) and p != q
    known = [r for r in rows if r[0] is not None]
    want = sorted(r for r in known if not any(over(p, r) for p in known))
    assert sorted(tuple(r) for r in calibrate.pareto_front(df, names, fan_in=2).collect()) == want


def test_items_name_some_and_offenders_are_all(spark):
    rows = [(i, i + 10_000, 0, 0, float(i), float(i + 1), 5.0, 4.0 if i % 2 else 6.0) for i in range(3000)]
    values = spark.createDataFrame(rows, "base long, perturbed long, axis int, output int, x0 double, x1 double, y0 double, y1 double")
    item = evidence.monotone_check(values, 3, 0, 0).first()
    named = evidence.monotone_offenders(values, 3, 0, 0)
    assert item.magnitude == pytest.approx(0.5 * 0.2) and len(item.observations) == evidence.NAMED and named.count() == 3000
    assert item.observations == sorted({i for r in rows if r[7] < r[6] for i in r[:2]})[: evidence.NAMED]
    own = calibrate.own_evidence(evidence.monotone_check(values, 3, 0, 0), offenders=named)
    assert own.count() == 3000 and own.select("id").distinct().count() == 3000
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalLimit" in plan(evidence.monotone_check(values, 3, 0, 0))
    keyed = values.withColumn("campaign", values.base % 7)
    assert "WindowGroupLimit" in plan(evidence.monotone_check(keyed, 3, 0, 0, keys=["campaign"]))


def test_protocols(spark, tmp_path):
    d = {"schema": "x.protocol/4", "id": "p", "plan": {"strategies": ["random"], "seeds": [1], "budgets": [40, 80], "probe_every": 5, "certify_density": 9}, "arms": [{"name": "A", "ablate": ["Numerical"]}, {"name": "B", "certify": "density"}], "entries": ["e"]}
    (tmp_path / "p.json").write_text(json.dumps(d))
    rows = protocol.read_protocols(spark, str(tmp_path / "*.json")).orderBy("arm").collect()
    assert [(r.arm, r.silenced, r.certify, r.budgets) for r in rows] == [("A", ["Numerical"], "size", [40, 80]), ("B", [], "density", [40, 80])]
    p = protocol.Protocol.read(json.dumps(d))
    models = {"e": compile_model(FLAT)}
    jobs = p.campaigns("A", models)
    c = campaign.config_of(jobs[0][2])
    assert (c.silenced, c.probe_every, c.policy.certify_density) == (("Numerical",), 5, 9)
    done = spark.createDataFrame([(jobs[0][0],)], "campaign string")
    assert [j[0] for j in p.remaining("A", models, done)] == [jobs[1][0]]
    for wrong, said in (({"schema": "x.protocol/9"}, "schema"), ({"arms": [{"name": "A", "ablate": ["Smell"]}]}, "channel"), ({"schema": "x.protocol/2"}, "certify is not"), ({"arms": [{"name": "A"}, {"name": "A"}]}, "one name")):
        with pytest.raises(protocol.ProtocolError, match=said):
            protocol.Protocol.read(json.dumps(d | wrong))
    with pytest.raises(protocol.ProtocolError, match="no arm"):
        p.arm("C")
    with pytest.raises(protocol.ProtocolError, match="no model"):
        p.campaigns("A", {})


def test_brackets_against_all_pairs():
    """The widest opposite pair of the largest leaf, whatever was kept on the way."""
    rnd = random.Random(1)
    m = compile_model("model m { input a in [0, 1] input b in [0, 1] }")
    space = partition.Partition(m.params, atlas.Policy(max_depth=6))
    found, kept = search.Brackets(2), []
    for k in range(120):
        x, below = [rnd.random(), rnd.random()], rnd.random() < 0.3
        space.add(x, 0.9 if below else 0.1, 2, 2, below)
        found.add(x, x, below, space)
        kept.append((x, below))
        if k % 40 == 39:
            space.judge()
            space.divide()
        best = None
        for i, (p, s) in enumerate(kept):
            for q, t in kept[i + 1 :]:
                leaf = int(space.holding(p)[0])
                if s != t and leaf == int(space.holding(q)[0]):
                    key = (space.volume[leaf], -leaf, sum((a - b) ** 2 for a, b in zip(p, q, strict=True)))
                    if best is None or key > best[0]:
                        best = (key, [(a + b) / 2 for a, b in zip(p, q, strict=True)])
        got = found.middle(space)
        assert (got is None) == (best is None) and (best is None or np.allclose(got, best[1]))


def test_ledger_is_the_same_step_by_step():
    rnd = random.Random(3)
    sets = [[readings.Item(rnd.choice(evidence.CHANNELS), "s", rnd.random(), [k], rnd.random()) for _ in range(rnd.randint(1, 4))] for k in range(30)]
    step = readings.Ledger()
    for s in sets:
        step.add(s)
    assert step.correlation() == readings.correlation(sets) and vars(readings.Scales(step)) == vars(readings.Scales(sets))


def test_unequal_spaces_are_not_fully_comparable(spark):
    rows = spark.createDataFrame([("cells", "p", "a", "b", "changed"), ("model", "q", "a", "a", "same")], "section string, path string, a string, b string, status string")
    assert compare.verdict(rows).first()[0] == "differing" and compare.verdict(compare.skipping(rows, 1, 2)).first()[0] == "not fully comparable"


def test_refused_overlap_takes_the_union_with_it(spark):
    cells = spark.createDataFrame([(0, 0, 9, [0.0], [1.0], "TRUSTED")], "cell int, depth int, samples long, lo array<double>, hi array<double>, label string")
    shares = spark.createDataFrame([(0, None)], "cell int, overlap double")
    row = regions.volumes(cells, shares, ([0.0], [1.0]), atlas.Policy()).first()
    assert (row.trusted_volume, row.refusals, row.trusted_over_true_union, row.coarse_certified_volume, row.thin_certified_volume) == (1.0, 1, None, 1.0, 1.0)


def test_arms_earlier_and_later(spark):
    schema = "entry string, strategy string, seed int, budget int, control boolean, localised boolean, evaluations int, suspicious double"
    rows = lambda ls: spark.createDataFrame([("e", "s", 1, b, False, loc, 5, 0.0) for b, loc in ls], schema)
    plans = spark.createDataFrame([("x", "1", "1")], "field string, full string, arm string")
    got = metrics.ablation_pairs(rows([(1, False), (2, True), (3, True)]), rows([(1, True), (2, True), (3, True)]), plans).collect()
    assert sorted((r.budget, r.status) for r in got) == [(1, "arm_only"), (2, "earlier"), (3, "both")]
    alone = metrics.ablation_pairs(rows([(1, True)]), rows([(1, True), (9, True)]), plans).collect()
    assert [(r.status, r.reason) for r in alone] == [("refused", "no partner for e/s/1/9")]
