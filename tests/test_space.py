"""Distances of doubles, trees of cells, joins along a scale, running values and lattices, against brute force."""

import itertools
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import distance
from plumbline.operators import asof, atlas, brackets, compare, dyadic, intervals, lattice, ranges, scans


def bits_of(x):
    return struct.unpack("<q", struct.pack("<d", x))[0]


SPECIAL = [0.0, -0.0, 1.0, math.nextafter(1.0, 2.0), -1.0, 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, math.nan, 0.1, 0.3, 1e-300, None]


def test_ulps(spark):
    def want(a, b):
        if a is None or b is None:
            return None
        if a != a or b != b:
            return 2**64 - 1
        if a == b:
            return 0
        wrapped = (bits_of(a) - bits_of(b)) % 2**64
        return min(wrapped, 2**64 - wrapped)

    pairs = list(itertools.product(SPECIAL, SPECIAL))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a double, b double")
    got = {r.i: r for r in rows.select("i", distance.bits(F.col("a")).alias("bits"), distance.ordinal(F.col("a")).alias("ordinal"), distance.ulps(F.col("a"), F.col("b")).alias("ulps"), distance.in_epsilons(F.col("a"), F.col("b")).alias("eps")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i].bits == (None if a is None else bits_of(a))
        assert (None if got[i].ulps is None else int(got[i].ulps)) == want(a, b)
    known = sorted((a, got[i].ordinal) for i, (a, b) in enumerate(pairs) if a is not None and a == a and b == 1.0)
    assert all(x[1] < y[1] or x[0] == y[0] for x, y in itertools.pairwise(known))
    at = pairs.index((1.0, math.nextafter(1.0, 2.0)))
    assert got[at].eps == pytest.approx(1.0)


# ---- trees of cells


def tree_points(spark, n=3000, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.choice([rnd.random(), round(rnd.random() * 8) / 8]), rnd.random() * 2 - 1]
        bad = (x[0] - 0.4) ** 2 + x[1] ** 2 < 0.09
        rows.append((i, x, 1.0 if bad else rnd.random() * 0.1, 2 if bad else 0, bad, 3))
    rows += [(n, [1.5, 0.0], 1.0, 2, True, 3), (n + 1, [float("nan"), 0.0], 1.0, 2, True, 3)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, risk double, channels int, fact boolean, measured int")


def brute_tree(rows, lo, hi, depth, policy):
    """Refinement by the plain rule: boxes with their points, all pairs for neighbours."""
    inside = [r for r in rows if all(a <= v <= b for v, a, b in zip(r[1], lo, hi, strict=True))]
    leaves = [(0, (tuple(lo), tuple(hi)), inside)]

    def label(pts):
        if not pts:
            return "UNKNOWN"
        mean, top = sum(p[2] for p in pts) / len(pts), max(p[2] for p in pts)
        if top >= policy.suspicious_peak or mean >= policy.suspicious_mean:
            return "SUSPICIOUS" if any(p[2] >= policy.suspicious_mean and (p[4] or bin(p[3]).count("1") >= 2) for p in pts) else "UNKNOWN"
        return "UNKNOWN" if len(pts) < policy.min_samples else "TRUSTED"

    while True:
        said = [label(pts) for _, _, pts in leaves]
        out, split = [], False
        for k, (d, (a, b), pts) in enumerate(leaves):
            meets = said[k] != "UNKNOWN" and any(said[j] not in ("UNKNOWN", said[k]) and all(a[i] <= q[i] and p[i] <= b[i] for i in range(2)) for j, (_, (p, q), _) in enumerate(leaves))
            wants = said[k] == "SUSPICIOUS" or (pts and sum(p[2] for p in pts) / len(pts) > policy.refine_below) or meets
            if not (d < depth and len(pts) >= policy.min_samples and wants):
                out.append((d, (a, b), pts))
                continue
            split = True
            axis = max(range(2), key=lambda i: ((b[i] - a[i]) / (hi[i] - lo[i]), i))
            mid = (a[axis] + b[axis]) / 2
            for side in (0, 1):
                a2, b2 = list(a), list(b)
                (b2 if side == 0 else a2)[axis] = mid
                out.append((d + 1, (tuple(a2), tuple(b2)), [p for p in pts if (p[1][axis] > mid) == bool(side)]))
        leaves = out
        if not split:
            return sorted((d, a, b, len(pts), label(pts)) for d, (a, b), pts in leaves)


def test_refinement_to_the_end(spark):
    rows, df = tree_points(spark)
    tree = dyadic.Tree((0.0, -1.0), (1.0, 1.0), 8)
    policy = atlas.Policy(max_depth=8)
    cells = dyadic.refined(df, tree, policy)
    low, high = ([F.round(tree.bound(i, s), 12) for i in range(2)] for s in (0, 1))
    got = sorted((r.depth, tuple(r.lo), tuple(r.hi), r.samples, r.label) for r in cells.select("depth", F.array(*low).alias("lo"), F.array(*high).alias("hi"), "samples", "label").collect())
    assert got == brute_tree(rows, (0.0, -1.0), (1.0, 1.0), 8, policy) and len(got) > 40
    located = {r.id: (r.leaf_depth, r.leaf_key) for r in dyadic.located(df, cells, tree).collect()}
    assert len(located) == len(rows) and located[3000] == located[3001] == (None, None)
    boxes = {(r.depth, r.key): r for r in cells.select("depth", "key", F.array(*low).alias("lo"), F.array(*high).alias("hi")).collect()}
    for i, x, *_ in rows[:3000]:
        box = boxes[located[i]]
        assert all(a <= v <= b for v, a, b in zip(x, box.lo, box.hi, strict=True))
    old, _ = atlas.build(df, ([0.0, -1.0], [1.0, 1.0]), policy=policy)
    assert sorted((r.depth, r.samples, r.label) for r in old.collect()) == sorted((d, n, label) for d, _, _, n, label in got)


def test_refinement_has_no_nested_loop(spark):
    _, df = tree_points(spark, 400)
    tree = dyadic.Tree((0.0, -1.0), (1.0, 1.0), 4)
    cells = dyadic.refined(df, tree)
    met = dyadic.meetings(cells, tree)
    plan = met._jdf.queryExecution().executedPlan().toString() + dyadic.disagreeing(cells, met)._jdf.queryExecution().executedPlan().toString() + dyadic.located(df, cells, tree)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trees_of_nothing_and_of_many_axes(spark):
    _, df = tree_points(spark, 10)
    tree = dyadic.Tree((0.0, -1.0), (1.0, 1.0), 4)
    assert [(r.depth, r.samples, r.label) for r in dyadic.refined(df.limit(0), tree).collect()] == [(0, 0, "UNKNOWN")]
    three = dyadic.Tree((0.0,) * 3, (1.0,) * 3, 7)
    assert [three.axis_at(d) for d in range(4)] == [2, 1, 0, 2] and three.halved(2, 7) == 3
    with pytest.raises(ValueError, match="deep"):
        dyadic.Tree((0.0,), (1.0,), 99)
    one = spark.createDataFrame([(0, [0.3, 0.6, 0.9])], "id int, x array<double>")
    r = dyadic.deepest(one, three).first()
    assert (r.c0, r.c1, r.c2) == (1, 2, 7) and r.key == int("1101011", 2)


def test_permitted_cells(spark):
    box = spark.createDataFrame([([0.0, 0.0], [4.0, 1.0])], "lo array<double>, hi array<double>")
    cells = dyadic.permitted(box, 5).collect()
    assert sorted((d, sum(c.depth == d for c in cells)) for d in range(6)) == [(d, 2**d) for d in range(6)]
    assert all(sum((c.hi[0] - c.lo[0]) * (c.hi[1] - c.lo[1]) for c in cells if c.depth == d) == 4.0 for d in range(6))
    assert len({(c.depth, c.key) for c in cells}) == len(cells)
    flat = spark.createDataFrame([([0.0, 2.0], [1.0, 2.0])], "lo array<double>, hi array<double>")
    assert {c.lo[1] for c in dyadic.permitted(flat, 3).collect()} == {2.0}
    point = spark.createDataFrame([([1.0], [1.0])], "lo array<double>, hi array<double>")
    assert dyadic.permitted(point, 3).count() == 1
    with pytest.raises(ValueError, match="more than 100"):
        dyadic.permitted(box, 7, cap=100)


# ---- along a scale


def sides(spark, seed=5, n=300, keys=3):
    rnd = random.Random(seed)
    left = [(i, rnd.choice([None, *range(keys)]), rnd.choice([None, rnd.randint(0, 60)])) for i in range(n)]
    right = [(i, rnd.choice([None, *range(keys + 1)]), rnd.choice([None, rnd.randint(0, 60)])) for i in range(80)]
    return left, right, spark.createDataFrame(left, "id long, k long, t long").repartition(4), spark.createDataFrame(right, "rid long, k long, t long").repartition(3)


@pytest.mark.parametrize("direction", [asof.BACKWARD, asof.FORWARD, asof.NEAREST])
@pytest.mark.parametrize(("by", "count"), [((), 1), (("k",), 7), ((), 40)])
def test_asof(spark, direction, by, count):
    left, right, a, b = sides(spark)

    def want(k, t):
        mine = [] if t is None or by and k is None else [r for r in right if r[2] is not None and (not by or r[1] == k) and (not by or r[1] is not None)]
        back = max((r for r in mine if r[2] <= t), key=lambda r: (r[2], r[0]), default=None)
        ahead = min((r for r in mine if r[2] > t), key=lambda r: (r[2], -r[0]), default=None)
        if direction == asof.BACKWARD:
            return back
        if direction == asof.FORWARD:
            return ahead
        return back if back and (not ahead or t - back[2] <= ahead[2] - t) else ahead

    made = asof.join(a, b, "t", by=by, tie=["rid"], direction=direction, ranges=count)
    got = {r.id: r.match and r.match.rid for r in made.collect()}
    assert got == {i: (m := want(k, t)) and m[0] for i, k, t in left} and made.count() == len(left)


def test_asof_of_nothing_and_of_wrong_directions(spark):
    _, _, a, b = sides(spark)
    assert asof.join(a, b.limit(0), "t").where("match is not null").count() == 0
    assert asof.join(a.limit(0), b, "t").count() == 0
    with pytest.raises(ValueError, match="direction"):
        asof.join(a, b, "t", direction="sideways")


def test_ranges_are_even(spark):
    rows = spark.range(10_000).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.col("id").alias("t"))
    rows = rows.withColumn("k", F.lit(1))
    cuts = ranges.splitters(rows, ["k", "t"], 20)
    sizes = [r["count"] for r in rows.groupBy(ranges.range_of(rows, ["k", "t"], cuts).alias("p")).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 3 * min(sizes) + 400


@pytest.mark.parametrize("levels", [0, 1, 3, 5])
def test_segment_nodes(spark, levels):
    top = 2**levels
    rows = spark.createDataFrame([(a, b) for a in range(top) for b in range(-1, top)], "lo long, hi long")
    for r in rows.select("lo", "hi", intervals.nodes(F.col("lo"), F.col("hi"), levels).alias("n")).collect():
        covered = [x for n in r.n for x in range(n["index"] << n["level"], (n["index"] + 1) << n["level"])]
        assert sorted(covered) == list(range(r.lo, r.hi + 1)) and len(r.n) <= max(1, 2 * levels)


def test_interval_joins(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["p", "q", None]), lo, rnd.choice([lo + rnd.randint(-2, 30), None])) for i in range(150) for lo in [rnd.randint(-1000, 1000)]]
    df = spark.createDataFrame(rows + rows[:2], "id long, k string, lo long, hi long")
    known = [r for r in rows + rows[:2] if r[3] is not None and r[2] <= r[3]]
    got = sorted((r.a.id, r.b.id) for r in intervals.overlapping(df, df).collect())
    assert got == sorted((a[0], b[0]) for a in known for b in known if a[2] <= b[3] and b[2] <= a[3])
    keyed = sorted((r.a.id, r.b.id) for r in intervals.overlapping(df, df, by=["k"]).collect())
    assert keyed == sorted((a[0], b[0]) for a in known for b in known if a[1] is not None and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert intervals.overlapping(df.limit(0), df).count() == 0
    plan = intervals.overlapping(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("count", [1, 9])
def test_overlap_totals(spark, count):
    rnd = random.Random(8)
    far = 1 << 52
    rows = [(i, lo, rnd.choice([lo, lo + rnd.randint(0, 30), lo + rnd.randint(-3, 300)])) for i in range(400) for lo in [far + rnd.randint(0, 400)]] + [(900, None, far), (901, far, None)]
    known = [r for r in rows if None not in r and r[1] <= r[2]]
    made = intervals.overlap_totals(spark.createDataFrame(rows, "id long, lo long, hi long").repartition(5), ["id"], ranges=count)
    got = {r.id: (r.met, r.shared) for r in made.collect()}
    meet = lambda a: [min(a[2], b[2]) - max(a[1], b[1]) for b in known if a[1] <= b[2] and b[1] <= a[2]]
    assert got == {a[0]: (len(meet(a)), sum(meet(a))) for a in known}
    assert intervals.overlap_totals(spark.createDataFrame([], "id long, lo long, hi long"), ["id"]).count() == 0


# ---- brackets


@pytest.mark.parametrize(("axes", "few"), [(2, 4096), (1, 4096), (2, 8)])
def test_widest_brackets(spark, monkeypatch, axes, few):
    monkeypatch.setattr(brackets, "FEW", few)
    rnd = random.Random(6)
    rows = [(c, i, [rnd.choice([rnd.random(), rnd.randint(0, 4) / 4]) for _ in range(2)], rnd.choice([-1.0, 0.0, 2.0, None])) for i in range(400) for c in [rnd.choice([1, 2, 3])]]
    rows += [(4, 900, [0.1, 0.1], -1.0), (4, 901, [0.2, 0.2], -2.0), (5, 902, [0.5, 0.5], -1.0), (5, 903, [0.5, 0.5], 1.0), (None, 904, [0.0, 0.0], -1.0), (None, 905, [1.0, 0.0], 1.0)]
    df = spark.createDataFrame(rows, "cell long, id long, u array<double>, level double").repartition(5)
    want = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c and r[3] is not None]
        pairs = [(sum((p - q) ** 2 for p, q in zip(a[2][:axes], b[2][:axes], strict=True)), -a[1], -b[1]) for a in mine for b in mine if a[3] < 0 <= b[3]]
        if pairs and max(pairs)[0] > 0:
            want[c] = (-max(pairs)[1], -max(pairs)[2], pytest.approx(max(pairs)[0]))
    got = {r.cell: (r.failing, r.holding, r.gap2) for r in brackets.widest(df, axes=axes).collect()}
    assert got == want and 4 not in got and 5 not in got


@pytest.mark.parametrize("place", [lambda t: (t, 0.3), lambda t: (0.3, t), lambda t: (t, t), lambda t: (t, 1.0 - 3 * t), lambda t: (t, t * t)])
def test_points_on_an_edge_are_no_corners(place):
    t = np.arange(2001) / 4096  # whole sums and products, so all lie on the line exactly
    x, y = np.array([place(v) for v in t]).T
    order = np.lexsort([y, x])
    got = brackets.corners(x[order], y[order])
    assert len(got) == (2001 if place(0.5)[1] == 0.25 else 2)
    assert {0, 2000} <= set(got.tolist())


# ---- running values


@pytest.mark.parametrize("count", [1, 9, 60])
def test_running_values(spark, count):
    rnd = random.Random(9)
    rows = [(i, rnd.choice(["hot", "hot", "hot", "b", "c"]), rnd.randint(0, 50), rnd.choice([None, float("nan"), -1.0, rnd.random() * 9])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t long, g double").repartition(6)
    value, n, want = {}, {}, {}
    for i, k, _, g in sorted(rows, key=lambda r: (r[2], r[0])):
        value[k] = 0.7 * value.get(k, 0.0) + 0.3 * (g if g is not None and g == g and g > 0 else 0.0)
        n[k] = n.get(k, 0) + 1
        want[i] = (n[k], value[k])
    numbered = scans.numbered(df, ["k"], ["t", "id"], "n", count)
    got = {r.id: (r.n, r.value) for r in scans.fading(numbered, ["k"], ["t", "id"], "g", 0.3, ranges=count).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-12, abs=1e-15) for i in want)
    total = {r.id: r.nr for r in scans.numbered(df, [], ["t", "id"], "nr", count).collect()}
    assert [i for i, _ in sorted(total.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert scans.fading(df.limit(0), ["k"], ["t", "id"], "g", 0.3).count() == 0


# ---- lattices


def test_lattice_layers(spark):
    sizes = (4, 3, 5)
    rnd = random.Random(2)
    sites = {k: (rnd.random() < 0.3, rnd.random() < 0.5) for k in range(60) if rnd.random() < 0.8}
    df = spark.createDataFrame([(k, i, v) for k, (i, v) in sites.items()], "key long, inside boolean, violated boolean")
    at = lambda k: (k % 4, k // 4 % 3, k // 12)
    near = lambda k: any(o != k and sites[o][0] and all(abs(p - q) <= 1 for p, q in zip(at(k), at(o), strict=True)) for o in sites)
    want = {k: ("agrees" if v else "empty") if i else "agrees" if not v else "boundary" if near(k) else "stray" for k, (i, v) in sites.items()}
    assert {r.key: r.verdict for r in lattice.layered(df, sizes).collect()} == want
    halo = df.select("key", lattice.halo(F.col("key"), sizes).alias("h")).collect()
    assert all(sorted(r.h) == sorted(o for o in range(60) if o != r.key and all(abs(p - q) <= 1 for p, q in zip(at(r.key), at(o), strict=True))) for r in halo)


# ---- documents


def test_json_paths(spark):
    texts = ['{"a": {"b": [1, 2, {"c": []}], "é x": "q\\"uote"}, "n": null, "t": true, "f": 1.5}', "[]", "7", "null", "{}", '{"a":', None, '[[["deep"]]]', '{"_path": {"_v": 1}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    got = sorted((r.id, r.path, r.value) for r in compare.json_paths(df, "doc", ["id"]).collect())
    assert got == sorted(
        [(0, "a.b[0]", "1"), (0, "a.b[1]", "2"), (0, "a.b[2].c", "[]"), (0, "a.é x", '"q\\"uote"'), (0, "n", "null"), (0, "t", "true"), (0, "f", "1.5"), (1, "", "[]"), (2, "", "7"), (3, "", "null"), (4, "", "{}"), (7, "[0][0][0]", '"deep"'), (8, "_path._v", "1")]
    )
    assert compare.json_paths(df.limit(0), "doc", ["id"]).count() == 0
