"""Driver queries of the language, its executors, generators, minimal cases, records and comparisons, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lang import executors, units
from plumbline.lang.model import compile_model, from_text, to_text
from plumbline.lang.syntax import ModelError
from plumbline.operators import compare, evidence, metrics, minimal, regions
from plumbline.operators.atlas import Policy
from plumbline.plans.queries import (
    BOUNDS, CELLS_SQL, OBS_SQL, OUTCOMES_SQL, REGIONS_SQL, ROOT, SPLITS, STEPS_SQL, TOUCH_SQL, cells, observations, outcomes, points, query, read, shown, shown_sql, truth, values,
)
from plumbline.sources import corpus, records, sample
from plumbline.sources.sample import Axis

# ---- the language: one model by three executors, over lineitem ----------------------------------------------------------

PRICE = """model price "a line's worth" {
  input q in [0, 60]
  input d in [0, 1]
  let net = q * (1 - d)
  let rate = q / (d * 100 - 5)
  let mixed = abs(net - 25) + clamp(q, 5, 45) + lerp(1, q, 0.25) + floor(net) + hypot(q, 3) + min(q, 30) - max(d, 0.02)
  let fine = sqrt(net - 20)
  require net <= 42 and d < 0.095
  require finite(fine)
}"""
PRICE_SQL = "WITH " + OBS_SQL + f""", v AS (SELECT id, q, d, y AS net, d * 100.0::DOUBLE - 5.0 AS below, y - 20.0 AS deep FROM obs)
  SELECT id, {shown_sql('net')} AS net, CASE WHEN below = 0 THEN 'inf' ELSE printf('%.6f', q / below) END AS rate,
    {shown_sql('abs(net - 25.0) + greatest(5.0, least(45.0, q)) + (1.0 + (q - 1.0) * 0.25) + floor(net) + sqrt(q * q + 9.0) + least(q, 30.0) - greatest(d, 0.02)', 6)} AS mixed,
    CASE WHEN deep < 0 THEN 'nan' ELSE printf('%.6f', sqrt(deep)) END AS fine,
    (CASE WHEN below = 0 THEN 6 ELSE 0 END) | (CASE WHEN deep < 0 THEN 9 ELSE 0 END) AS flags,
    (CASE WHEN net <= 42 THEN 0 ELSE 1 END) + (CASE WHEN d < 0.095 THEN 0 ELSE 1 END) + (CASE WHEN deep < 0 THEN 1 ELSE 0 END) AS violated FROM v"""


def price(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    m = compile_model(PRICE)
    done = executors.execute(observations(spark, sf_dir).select("id", "x"), m, by)
    net, rate, mixed, fine = (F.get("y", F.lit(i)) for i in range(4))
    side = lambda k, i: F.get(F.get("rules", F.lit(k)), F.lit(i))
    rules = [evidence.Rule(r.id, side(k, 0), r.op, side(k, 1) if r.right else None, r.tolerance) for k, r in enumerate(m.rules)]
    broken = sum((evidence.violation(r).isNotNull().cast("int") for r in rules[1:]), evidence.violation(rules[0]).isNotNull().cast("int"))
    return done.select("id", shown(net).alias("net"), shown(rate, 6).alias("rate"), shown(mixed, 6).alias("mixed"), shown(fine, 6).alias("fine"), "flags", broken.alias("violated"))


@query(PRICE_SQL)
def model_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price(spark, sf_dir, "columns")


@query(PRICE_SQL)
def model_by_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price(spark, sf_dir, "lanes")


@query(PRICE_SQL)
def model_by_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price(spark, sf_dir, "scalar")


SINGLE = "model single { input q in [0, 60] input d in [0, 1] let net = q * (1 - d) }"


@query("WITH " + OBS_SQL + " SELECT id, printf('%.12f', CAST(CAST(q AS FLOAT) * CAST(CAST(1 AS FLOAT) - CAST(d AS FLOAT) AS FLOAT) AS DOUBLE)) AS net FROM obs")
def model_single_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = executors.execute(observations(spark, sf_dir).select("id", "x"), compile_model(SINGLE), "lanes-f32")
    return done.select("id", shown(F.get("y", F.lit(0)), 12).alias("net"))


SPRING = """model spring {
  input dt in [0, 1]
  state x = 1.0
  state v = 0.0
  loop 5 {
    let before = x
    advance x = x + v * dt
    advance v = v - before * dt
    watch x
  }
  let energy = 0.5 * (x * x + v * v)
}"""


@query("""WITH RECURSIVE s(p_partkey, dt, k, x, v, top) AS (
    SELECT p_partkey, p_size / 200.0::DOUBLE, 0, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM part
    UNION ALL SELECT p_partkey, dt, k + 1, x + v * dt, v - x * dt, greatest(top, x + v * dt) FROM s WHERE k < 5)
  SELECT p_partkey AS id, round(0.5 * (x * x + v * v), 9) AS energy, 5 AS watched, round(top, 9) AS top FROM s WHERE k = 5""")
def model_loop_and_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / F.lit(200.0)).alias("x"))
    done = executors.execute(at, compile_model(SPRING))
    trace = F.get("traces", F.lit(0))
    return done.select("id", F.round(F.element_at("y", -1), 9).alias("energy"), F.size(trace).alias("watched"), F.round(F.array_max(trace), 9).alias("top"))


FAR = "model far { input a in [0, 60] let y = (a + 1e16) - 1e16 - a }"


@query("""SELECT p_partkey AS id, 'o0:paths' AS subject, 1.0::DOUBLE AS magnitude FROM (SELECT p_partkey, p_size * 0.25::DOUBLE + 0.5 AS a FROM part) WHERE ((a + 1e16::DOUBLE) - 1e16::DOUBLE) - a <> 0""")
def differential_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double precision against the reference path, which has enough digits here."""
    m = compile_model(FAR)
    at = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") * F.lit(0.25) + 0.5).alias("x"))
    found = evidence.path_gap(executors.execute(at, m, "lanes"), executors.execute(at, m, "reference"), "Differential")
    return found.select(F.get("observations", F.lit(0)).alias("id"), "subject", "magnitude")


@query("WITH " + OBS_SQL + ", m AS (SELECT id, q, d, y, NOT (q > 40) AND d * 2 >= 0.05 OR q / 10 = 1 AS told FROM obs) SELECT id, told FROM m")
def region_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir).select("id", "x")
    return obs.select("id", corpus.predicate_column("not (q > 40) and d * 2 >= 0.05 or q / 10 == 1", ["q", "d"]).alias("told"))


#: The fault of a part's model text, by its number modulo nine: what is put in and what the refusal says.
FAULTS = (
    ("", "", ""), ("bounds", "input x in [2, 1]", "empty"), ("unbounded", "input x in [0, inf]", "no bound"), ("choices", "input x in {1}", "two choices"), ("unknown name", "let z = w", "not known"),
    ("units", "input t : kg in [0, 1] let z = l + t", "different quantities"), ("arity", "let z = sqrt(a, a)", "takes 1"), ("or", "require a > 0 or a < 1", "or cannot"), ("trace", "check conserved(a)", "not watched"),
)
#: A part's own unit, by its number modulo five, with its dimension.
UNITS = (("V", "m^2*kg/s^3/A"), ("N", "m*kg/s^2"), ("J", "m^2*kg/s^2"), ("km", "m"), ("s", "s"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text): a model of every part, its size and price as bounds; one of odd size has a loop."""
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), F.col("p_partkey") % by)
    loop = F.when(F.col("p_size") % 2 == 1, " state s = 0.0 loop 3 { advance s = s + a }").otherwise("")
    text = F.concat(F.lit("model part { input a in [0, "), F.col("p_size").cast("string"), F.lit("] input l : "), pick([u for u, _ in UNITS], 5), F.lit(" in [1, "), (F.floor("p_retailprice") + 1).cast("string"), F.lit("] let y = a * 2 + 1 require y <= "), F.col("p_size").cast("string"), F.lit(" "), pick([f for _, f, _ in FAULTS], 9), loop, F.lit(" }"))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


def told_of_texts(texts: DataFrame) -> DataFrame:
    """What compiling each text says: why it was refused, its sizes, whether its text comes back, who can run it, and l's dimension."""

    def told(text: str) -> tuple:
        try:
            m = compile_model(text)
        except ModelError as e:
            return str(e), None, None, None, None, None, None
        runs = ",".join(e for e in ("columns", "lanes", "scalar") if executors.EXECUTORS[e].refuses(m) is None)
        return None, len(m.params), len(m.outputs), len(m.rules), to_text(from_text(to_text(m))) == to_text(m), runs, units.dim_text(m.param_units[1].dim)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, found = None, ()
        for f in frames:
            rows = []
            for key, text in f.itertuples(index=False):
                if not found or text != last:
                    last, found = text, told(text)
                rows.append((key, *found))
            yield pd.DataFrame(rows, columns=["p_partkey", "refusal", "inputs", "outputs", "rules", "same", "runs", "dimension"]).astype({"inputs": "Int64", "outputs": "Int64", "rules": "Int64"})

    # A table of few bytes is much work, so it is dealt over tasks by number, not by size; equal texts meet and are compiled once.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartition(tasks, "text").sortWithinPartitions("text")
    return dealt.mapInPandas(run, "p_partkey long, refusal string, inputs long, outputs long, rules long, same boolean, runs string, dimension string")


@query("SELECT p_partkey, 2 AS inputs, CASE WHEN p_size % 2 = 1 THEN 2 ELSE 1 END AS outputs, 1 AS rules, true AS same FROM part WHERE p_partkey % 9 = 0")
def model_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_of_texts(part_texts(spark, sf_dir)).where("refusal is null").select("p_partkey", *[F.col(c).cast("int").alias(c) for c in ("inputs", "outputs", "rules")], "same")


@query("SELECT p_partkey, ['', 'bounds', 'unbounded', 'choices', 'unknown name', 'units', 'arity', 'or', 'trace'][p_partkey % 9 + 1] AS fault, p_partkey % 9 > 0 AS refused FROM part")
def model_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts' texts are refused, and that the refusal names the fault."""
    by = lambda k: F.get(F.array(*[F.lit(x[k]) for x in FAULTS]), F.col("p_partkey") % len(FAULTS))
    told = told_of_texts(part_texts(spark, sf_dir))
    return told.select("p_partkey", by(0).alias("fault"), F.coalesce(F.col("refusal").contains(by(2)), F.lit(False)).alias("refused"))


@query("SELECT p_partkey, ['m^2*kg/s^3/A', 'm*kg/s^2', 'm^2*kg/s^2', 'm', 's'][p_partkey % 5 + 1] AS dimension FROM part WHERE p_partkey % 9 = 0")
def unit_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told_of_texts(part_texts(spark, sf_dir)).where("refusal is null").select("p_partkey", "dimension")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN 'lanes,scalar' ELSE 'columns,lanes,scalar' END AS runs FROM part WHERE p_partkey % 9 = 0")
def executor_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who can run a part's model: Columns have no loops."""
    return told_of_texts(part_texts(spark, sf_dir)).where("refusal is null").select("p_partkey", "runs")


# ---- generators ---------------------------------------------------------------------------------------------------------

DRAW_SQL = """
st AS (SELECT k, CAST(((xor(12345::UBIGINT, 11400714819323198485::UBIGINT))::UHUGEINT + k::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM (SELECT unnest(range(1, 2 * (SELECT count(*) FROM part) + 1)) AS k)),
a AS (SELECT k, CAST((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM st),
b AS (SELECT k, CAST((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS z FROM a),
u AS (SELECT k, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM b)"""
BOX_SQL = "box AS (SELECT min(l_extendedprice) AS a0, max(l_extendedprice) AS a1, min(l_tax) AS b0, max(l_tax) AS b1 FROM lineitem)"


def box(spark: SparkSession, sf_dir: str) -> tuple[int, list[Axis]]:
    """As many points as there are parts, and the axes of the box that lineitem's prices and taxes fill."""
    a0, a1, b0, b1 = read(spark, sf_dir, "lineitem").agg(*[f(c) for c in ("l_extendedprice", "l_tax") for f in (F.min, F.max)]).first()
    return read(spark, sf_dir, "part").count(), [Axis("a", a0, a1), Axis("b", b0, b1)]


def pair(points: DataFrame) -> DataFrame:
    return points.select("id", F.round(F.get("x", F.lit(0)), 6).alias("a"), F.round(F.get("x", F.lit(1)), 9).alias("b"))


@query("WITH " + DRAW_SQL + "," + BOX_SQL + " SELECT id, round(a0 + (a1 - a0) * ua, 6) AS a, round(b0 + (b1 - b0) * ub, 9) AS b FROM (SELECT (k - 1) // 2 AS id, max(u) FILTER (k % 2 = 1) AS ua, max(u) FILTER (k % 2 = 0) AS ub FROM u GROUP BY 1), box")
def uniform_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, axes = box(spark, sf_dir)
    return pair(sample.uniform(spark, n, axes, 12345))


@query("""WITH RECURSIVE """ + BOX_SQL + """, d(i, base, rest, place, sum) AS (
    SELECT i, base, i, 1.0::DOUBLE / base, 0.0::DOUBLE FROM (SELECT unnest(range(1, (SELECT count(*) FROM part) + 1)) AS i), (VALUES (2), (3)) b(base)
    UNION ALL SELECT i, base, rest // base, place / base, sum + (rest % base) * place FROM d WHERE rest > 0)
  SELECT id, round(a0 + (a1 - a0) * u, 6) AS a, round(b0 + (b1 - b0) * v, 9) AS b FROM (SELECT i - 1 AS id, max(sum) FILTER (base = 2) AS u, max(sum) FILTER (base = 3) AS v FROM d GROUP BY i), box""")
def halton_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, axes = box(spark, sf_dir)
    return pair(sample.halton(spark, n, axes))


SIDE_SQL = "side AS (SELECT CAST(floor(sqrt((SELECT count(*) FROM part))) AS BIGINT) AS s)"


@query("WITH " + BOX_SQL + "," + SIDE_SQL + " SELECT i AS id, round(a0 + (a1 - a0) * ((i % s + 0.5) / s), 6) AS a, round(b0 + (b1 - b0) * (((i // s) % s + 0.5) / s), 9) AS b FROM box, side, (SELECT unnest(range(0, (SELECT s * s FROM side))) AS i)")
def midpoint_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, axes = box(spark, sf_dir)
    return pair(sample.grid(spark, math.isqrt(n), axes, midpoints=True))


@query("WITH " + BOX_SQL + "," + SIDE_SQL + " SELECT i AS id, round(a0 + (i % s) / (s - 1.0) * (a1 - a0), 6) AS a, [1.0::DOUBLE, 4.0, 9.0][CAST(least(floor(((i // s) % s) / (s - 1.0) * 3), 2) AS INT) + 1] AS b FROM box, side, (SELECT unnest(range(0, (SELECT s * s FROM side))) AS i)")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, axes = box(spark, sf_dir)
    return pair(sample.grid(spark, math.isqrt(n), [axes[0], Axis("b", choices=(1.0, 4.0, 9.0))]))


@query("WITH " + OBS_SQL + " SELECT id AS base, d AS first, q AS second FROM obs")
def swapped_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.swapped(observations(spark, sf_dir).select("id", "x"), 0, 1).select("base", F.get("x", F.lit(0)).alias("first"), F.get("x", F.lit(1)).alias("second"))


@query("""WITH RECURSIVE n AS (SELECT n_name, encode(n_name) AS b FROM nation), h(n_name, b, i, h) AS (
    SELECT n_name, b, 0, 14695981039346656037::UHUGEINT FROM n
    UNION ALL SELECT n_name, b, i + 1, (xor(h::UBIGINT, ascii(n_name[i + 1])::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT FROM h WHERE i < length(n_name))
  SELECT n_name, CAST(h AS VARCHAR) AS seed FROM h WHERE i = length(n_name)""")
def label_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r[0] for r in read(spark, sf_dir, "nation").select("n_name").distinct().collect()]  # 25 nations
    return spark.createDataFrame([(n, str(sample.label_seed(n))) for n in names], "n_name string, seed string")


# ---- patterns, volumes, costs ----------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS base, p_partkey + 1 AS perturbed, p_retailprice AS y0, lead(p_retailprice) OVER (ORDER BY p_partkey) AS y1 FROM part),
  st AS (SELECT *, abs(y1 - y0) / greatest(abs(y0), abs(y1), 1.0) AS rel, y1 < y0 AS wrong FROM p WHERE y1 IS NOT NULL),
  m AS (SELECT count(*) FILTER (wrong) AS violated, count(*) AS total, max(rel) FILTER (wrong) AS worst, abs(ln(median(rel) FILTER (wrong) / median(rel))) AS severity FROM st)
  SELECT 'o0~p0:monotone_up' AS subject, round(severity, 9) AS severity, (SELECT count(DISTINCT i) FROM (SELECT unnest([base, perturbed]) AS i FROM st WHERE wrong)) AS offenders
  FROM m WHERE violated > 0 AND violated * 4 < total AND worst > 1e-6 AND severity >= ln(2.0)""")
def inferred_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices rise with part numbers, but where they begin again."""
    part = read(spark, sf_dir, "part")
    obs = part.select(F.col("p_partkey").alias("id"), F.array(F.col("p_partkey").cast("double")).alias("x"), F.array("p_retailprice").alias("y"))
    probes = part.select(F.col("p_partkey").alias("base"), (F.col("p_partkey") + 1).alias("perturbed"), F.lit(0).alias("axis"))
    pairs = evidence.probe_values(obs, probes)
    named = evidence.offenders(evidence.broken_steps(pairs).where("wrong"), F.lit("o0~p0:monotone_up")).groupBy("subject").agg(F.count("*").alias("offenders"))
    return evidence.inferred_patterns(pairs).join(named, "subject").select("subject", F.round("magnitude", 9).alias("severity"), "offenders")


@query("WITH " + STEPS_SQL + """, t AS (SELECT 0.9::DOUBLE AS m) SELECT base, perturbed, round(abs(y1 - y0) / abs(x1 - x0) / m - 1, 9) AS magnitude FROM pairs, t WHERE x0 <> x1 AND abs(y1 - y0) / abs(x1 - x0) / m > 1.5""")
def sensitivity_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against frozen reference slopes instead of these pairs' own."""
    frozen = spark.createDataFrame([(0, 0, 0.9)], "axis int, output int, typical double")
    found = evidence.sensitivity(values(spark, sf_dir), reference=frozen)
    return found.select(F.get("observations", F.lit(0)).alias("base"), F.get("observations", F.lit(1)).alias("perturbed"), F.round("magnitude", 9).alias("magnitude"))


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + """,
  mids AS (SELECT cell, lo0 + (hi0 - lo0) * (i + 0.5) / 8 AS q, lo1 + (hi1 - lo1) * (j + 0.5) / 8 AS d FROM cells, range(8) a(i), range(8) b(j)),
  hit AS (SELECT cell, q, d, bool_or(q BETWEEN rl0 AND rh0 AND d BETWEEN rl1 AND rh1) AS inside FROM mids, reg GROUP BY cell, q, d)
  SELECT cell, round(avg(CASE WHEN inside THEN 1.0 ELSE 0.0 END), 9) AS overlap FROM hit GROUP BY cell""")
def union_overlap_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sampled_overlap(cells(spark, sf_dir), truth(spark), axes=2, per_axis=8).select("cell", F.round("overlap", 9).alias("overlap"))


VOLUMES_SQL = CELLS_SQL + "," + REGIONS_SQL + """,
  cov AS (SELECT cell, sum(greatest(least(c.hi0, rh0) - greatest(c.lo0, rl0), 0) * greatest(least(c.hi1, rh1) - greatest(c.lo1, rl1), 0)) AS covered FROM cells c, reg GROUP BY cell),
  two AS (SELECT cell, greatest(least(hi0, 50.0) - greatest(lo0, 44.0), 0) * greatest(least(hi1, 0.06) - greatest(lo1, 0.03), 0) AS common FROM cells),
  vs AS (SELECT c.*, (hi0 - lo0) / 49.0 * (hi1 - lo1) / 0.1 AS v, (covered - common) / ((hi0 - lo0) * (hi1 - lo1)) AS overlap FROM cells c JOIN cov USING (cell) JOIN two USING (cell))"""


@query("WITH " + VOLUMES_SQL + """ SELECT round(coalesce(sum(v) FILTER (label = 'TRUSTED'), 0), 9) AS trusted_volume, round(coalesce(sum(v) FILTER (label = 'SUSPICIOUS'), 0), 9) AS suspicious_volume,
  round(coalesce(sum(v) FILTER (label = 'TRUSTED' AND pow(0.5, 5) > 0.00390625), 0), 9) AS coarse_certified_volume, round(coalesce(sum(v) FILTER (label = 'TRUSTED' AND samples / pow(0.5, 5) < 60000), 0), 9) AS thin_certified_volume,
  round(coalesce(sum(v * overlap) FILTER (label = 'TRUSTED'), 0), 9) AS trusted_over_true_union, round(coalesce(sum(v * overlap) FILTER (label = 'SUSPICIOUS'), 0), 9) AS suspicious_over_true_union FROM vs""")
def certified_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cells(spark, sf_dir)
    out = regions.volumes(made, regions.union_overlap(made, truth(spark), axes=2), ROOT, Policy(certify_density=60000.0))
    return out.select(*[F.round(c, 9).alias(c) for c in ("trusted_volume", "suspicious_volume", "coarse_certified_volume", "thin_certified_volume", "trusted_over_true_union", "suspicious_over_true_union")])


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + f""", best AS (SELECT cell, region, greatest(least(c.hi0, rh0) - greatest(c.lo0, rl0), 0) * greatest(least(c.hi1, rh1) - greatest(c.lo1, rl1), 0) AS s FROM cells c JOIN reg ON {TOUCH_SQL}),
  one AS (SELECT cell, region FROM best QUALIFY row_number() OVER (PARTITION BY cell ORDER BY s DESC, region) = 1),
  nth AS (SELECT row_number() OVER (PARTITION BY region ORDER BY cell) AS n FROM one) SELECT round(count(*) FILTER (n > 1) / count(*), 9) AS duplicate_rate FROM nth""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.overlaps(cells(spark, sf_dir), truth(spark)).select(F.col("cell").alias("finding"), "region", F.col("overlap") * F.col("volume"))
    return regions.duplicate_rate(found.toDF("finding", "region", "overlap")).select(F.round("duplicate_rate", 9).alias("duplicate_rate"))


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + """, met AS (SELECT cell, label, region, rl0, rh0, rl1, rh1 FROM cells c JOIN reg ON c.lo0 < rh0 AND c.hi0 > rl0 AND c.lo1 < rh1 AND c.hi1 > rl1)
  SELECT m.cell, m.label, m.region, count(b.id) AS points, count(b.id) FILTER (b.risk >= 0.45) AS risky FROM met m LEFT JOIN binned b ON b.k0 * 4 + b.k1 = m.cell AND b.q BETWEEN rl0 AND rh0 AND b.d BETWEEN rl1 AND rh1 GROUP BY ALL""")
def row_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.greatest(F.ceil((F.get("x", F.lit(i)) - BOUNDS[i][0]) / F.lit((BOUNDS[i][1] - BOUNDS[i][0]) / (1 << SPLITS[i]))) - 1, F.lit(0))
    placed = points(spark, sf_dir).withColumn("cell", (at(0) * 4 + at(1)).cast("int"))
    return metrics.row_trace(cells(spark, sf_dir), placed, truth(spark))


COST_SQL = OUTCOMES_SQL + """,
  ct AS (SELECT strategy AS arm, entry, CASE WHEN seed = 2 AND budget = 40 THEN 1 ELSE 0 END AS refusals, CASE WHEN declared_regions > 0 THEN 0.25 ELSE 0.0 END AS declared_union, least(evaluations / 40.0, 1.0) AS trusted_volume, least(evaluations / 400.0, 0.2) AS trusted_over_true_union FROM oc),
  tb AS (SELECT arm, entry, count(*) AS rows, count(*) FILTER (refusals = 0 AND declared_union > 0) AS measured, count(*) FILTER (refusals = 0 AND declared_union <= 0) AS not_applicable, count(*) FILTER (refusals <> 0) AS not_measurable,
    avg(trusted_over_true_union / declared_union) FILTER (refusals = 0 AND declared_union > 0) AS s, avg(trusted_volume - trusted_over_true_union) FILTER (refusals = 0 AND declared_union > 0) AS c, avg(trusted_volume) AS t FROM ct GROUP BY ALL)"""


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = outcomes(spark, sf_dir)
    refused = F.when((F.col("seed") == 2) & (F.col("budget") == 40), 1).otherwise(0)
    union = F.when(F.col("declared_regions") > 0, 0.25).otherwise(0.0)
    rows = oc.select(F.col("strategy").alias("arm"), "entry", refused.alias("refusals"), union.alias("declared_union"), F.least(F.col("evaluations") / 40.0, F.lit(1.0)).alias("trusted_volume"), F.least(F.col("evaluations") / 400.0, F.lit(0.2)).alias("trusted_over_true_union"))
    return metrics.certified_over_region(rows)


@query("WITH " + COST_SQL + " SELECT arm, entry, rows, measured, not_applicable, not_measurable, round(s, 9) AS certified_over_region_share, round(c, 9) AS clean_certified_volume, round(t, 9) AS trusted_volume FROM tb")
def cost_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounded = [F.round(c, 9).alias(c) for c in ("certified_over_region_share", "clean_certified_volume", "trusted_volume")]
    return costs(spark, sf_dir).select("arm", "entry", "rows", "measured", "not_applicable", "not_measurable", *rounded)


@query("WITH " + COST_SQL + " SELECT a.arm, a.entry, round(b.s - a.s, 9) AS fall, round(b.c - a.c, 9) AS cost, round(a.c / b.c, 9) AS retained FROM tb a JOIN tb b ON a.entry = b.entry AND b.arm = 'random' AND a.arm <> 'random'")
def cost_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = metrics.exchange(costs(spark, sf_dir), "random")
    return made.select("arm", "entry", *[F.round(c, 9).alias(c) for c in ("fall", "cost", "retained")])


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    oc = outcomes(spark, sf_dir).withColumn("control", F.col("declared_regions") == 0)
    full = oc.withColumn("localised", F.col("localised_regions") >= 1)
    arm = oc.withColumn("localised", F.col("localised_regions") >= 2).withColumn("suspicious", F.col("suspicious") / 2)
    return full, arm


PAIRS_SQL = OUTCOMES_SQL + """,
  f AS (SELECT *, localised_regions >= 1 AS l, min(CASE WHEN localised_regions >= 1 THEN budget END) OVER (PARTITION BY entry, strategy, seed) AS first_f FROM oc),
  g AS (SELECT *, localised_regions >= 2 AS l, min(CASE WHEN localised_regions >= 2 THEN budget END) OVER (PARTITION BY entry, strategy, seed) AS first_a FROM oc)"""


@query("WITH " + PAIRS_SQL + """ SELECT status, count(*) AS n, round(sum(control_delta), 9) AS control_delta FROM (
  SELECT CASE WHEN f.l AND NOT g.l THEN 'full_only' WHEN g.l AND NOT f.l THEN 'arm_only' WHEN NOT f.l AND NOT g.l THEN 'neither' WHEN first_a < first_f AND f.budget = first_f THEN 'earlier' WHEN first_a > first_f AND f.budget = first_a THEN 'later' ELSE 'both' END AS status,
    CASE WHEN f.declared_regions = 0 THEN f.suspicious / 2 - f.suspicious END AS control_delta FROM f JOIN g USING (entry, strategy, seed, budget)) GROUP BY status""")
def ablation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    full, arm = _arms(spark, sf_dir)
    plans = spark.createDataFrame([("budgets", "40,80", "40,80"), ("certify_share", None, None)], "field string, full string, arm string")
    return metrics.ablation_pairs(full, arm, plans).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("control_delta"), 9).alias("control_delta"))


@query("SELECT * FROM (VALUES ('plans', 'refused', 'plans differ in budgets'), ('charge', 'refused', 'charged otherwise')) v(fault, status, reason)")
def ablation_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of unequal plans, or charged otherwise, are not compared."""
    full, arm = _arms(spark, sf_dir)
    same = spark.createDataFrame([("budgets", "40", "40")], "field string, full string, arm string")
    other = spark.createDataFrame([("budgets", "40", "80")], "field string, full string, arm string")
    a = metrics.ablation_pairs(full, arm, other).select(F.lit("plans").alias("fault"), "status", "reason")
    dear = arm.withColumn("evaluations", F.col("evaluations") + 1)
    b = metrics.ablation_pairs(full, dear, same).select(F.lit("charge").alias("fault"), "status", F.substring("reason", 1, 17).alias("reason"))
    return a.unionByName(b)


@query("""WITH e AS (SELECT event_type AS channel, event_id, value FROM events), a AS (SELECT channel, count(*) AS applied, count(*) FILTER (value > 1) AS computed, count(*) FILTER (value > 20) AS readings, count(*) FILTER (value > 20 AND least(value / 100, 1) >= 0.5) AS strong, count(DISTINCT event_id // 100) FILTER (value > 90) AS findings FROM e GROUP BY channel)
  SELECT *, channel = 'click' AS silenced FROM a""")
def channel_census_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "event_id", "value")
    applied = rows.groupBy("channel").agg(F.count("*").alias("applied"), F.count_if(F.col("value") > 1).alias("computed"))
    items = rows.where("value > 20").select("channel", F.least(F.col("value") / 100, F.lit(1.0)).alias("strength"))
    found = rows.where("value > 90").select("channel", F.floor(F.col("event_id") / 100).alias("finding"))
    return metrics.census(items, applied=applied, findings=found, silenced=["click"])


# ---- minimal cases ----------------------------------------------------------------------------------------------------------

LINES = "model lines { input q in [1, 50] input p in [900, 105000] input d in [0, 0.1] let net = p * (1 - d) let unit = p / q require net <= 100000 require unit <= 40000 }"


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_extendedprice * (1 - l_discount) > 100000 AS dear FROM lineitem
    WHERE l_extendedprice * (1 - l_discount) > 100000 OR l_extendedprice / l_quantity > 40000),
  k AS (SELECT *, NOT dear AND 50000 / q > 40000 AS one FROM c)
  SELECT l_orderkey, l_linenumber, CASE WHEN dear THEN 'q' WHEN one THEN 'p,d' ELSE 'd' END AS free, 1.0::DOUBLE AS q_lo, round(CASE WHEN dear THEN 50.0 WHEN one THEN 1.25 ELSE p / 40000 END, 9) AS q_hi,
    round(CASE WHEN dear THEN 100000 / (1 - d) WHEN one THEN 900.0 ELSE 40000 * q END, 4) AS p_lo, 105000.0::DOUBLE AS p_hi, 0.0::DOUBLE AS d_lo, round(CASE WHEN dear THEN 1 - 100000 / p ELSE 0.1 END, 6) AS d_hi FROM k""")
def minimal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that breaks a rule: the inputs that have nothing to do with it, and how far the others can go."""
    m = compile_model(LINES)
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_quantity", "l_extendedprice", "l_discount").alias("x"))
    found = minimal.broken_at(lines, m, F.col("x"), "fails").where("fails").drop("fails")
    made = minimal.edges(minimal.reduced(found, m, (25.0, 50000.0, 0.05)), m)
    names = F.array_join(F.transform("free", lambda i: F.get(F.array(*map(F.lit, "qpd")), i)), ",")
    ends = [F.round(F.get(side, F.lit(i)), n).alias(f"{name}_{side}") for i, (name, n) in enumerate((("q", 9), ("p", 4), ("d", 6))) for side in ("lo", "hi")]
    return made.select("l_orderkey", "l_linenumber", names.alias("free"), *ends)


# ---- records -----------------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT CAST(event_id // 16 AS VARCHAR) AS journal, event_id % 16 AS nr, event_id FROM events) SELECT l.journal, l.nr FROM l JOIN l before ON before.journal = l.journal AND before.nr = l.nr - 1 WHERE before.event_id % 50 = 7""")
def journal_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals of sixteen events each, every fiftieth line of which was changed afterwards: the lines behind do not fit."""
    events = read(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 16).cast("string").alias("journal"), (F.col("event_id") % 16).alias("nr"), "event_id")
    ids = events.groupBy("journal").agg(F.transform(F.sort_array(F.collect_list(F.struct("nr", "event_id"))), lambda v: v["event_id"]).alias("ids"))  # sixteen
    line = lambda acc, i: F.concat(F.lit('{"seq":'), F.size(acc["lines"]).cast("string"), F.lit(',"at":"2024-01-01T00:00:00Z","prev":"'), acc["prev"], F.lit('","kind":"note","payload":{"k":'), i.cast("string"), F.lit("}}"))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(records.ZERO).alias("prev"))
    made = ids.select("journal", "ids", F.aggregate("ids", start, lambda acc, i: F.struct(F.concat(acc["lines"], F.array(line(acc, i))).alias("lines"), F.sha2(line(acc, i).cast("binary"), 256).alias("prev")))["lines"].alias("lines"))
    rows = made.select("journal", F.posexplode(F.arrays_zip("ids", "lines")).alias("nr", "v"))
    changed = F.when(F.col("v.ids") % 50 == 7, F.replace(F.col("v.lines"), F.lit('"k":'), F.lit('"k":-'))).otherwise(F.col("v.lines"))
    return records.broken_links(rows.select("journal", F.col("nr").cast("long").alias("nr"), changed.alias("line")))


@query("""SELECT event_id, path, value FROM (SELECT event_id, unnest(['a.b[0]', 'a.b[1]', 'a.c[0][0].d', 'a.t', 'e', 'n', 'o']) AS path,
  unnest([CAST(event_id % 5 AS VARCHAR), CAST(event_id % 7 AS VARCHAR), CAST(CAST(props::JSON ->> 'k' AS INT) AS VARCHAR), '"' || event_type || '"', '[]', 'null', '{}']) AS value FROM events)""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, one made of every event, as paths."""
    rows, text = read(spark, sf_dir, "events"), lambda c: F.col(c).cast("string")
    doc = F.concat(F.lit('{"a": {"b": ['), (F.col("event_id") % 5).cast("string"), F.lit(", "), (F.col("event_id") % 7).cast("string"), F.lit('], "c": [[{"d": '), F.get_json_object("props", "$.k"), F.lit('}]], "t": "'), text("event_type"), F.lit('"}, "e": [], "n": null, "o": {}}'))
    return compare.json_paths(rows.select("event_id", doc.alias("doc")), "doc", ["event_id"])


@query("""SELECT p_brand, CASE WHEN count(*) FILTER (p_partkey % 97 = 0 AND p_size % 2 = 1) > 0 THEN 'differing' WHEN count(*) FILTER (p_size % 2 = 0) > 0 THEN 'not fully comparable' ELSE 'identical' END AS verdict FROM part GROUP BY p_brand""")
def comparison_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's parts as records against a copy in which some differ; those of even size are of spaces that cannot be compared."""
    part = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 2 == 0, "cells").otherwise("model").alias("section"), F.col("p_retailprice").alias("value"))
    other = part.withColumn("value", F.when(F.col("p_partkey") % 97 == 0, F.col("value") + 1).otherwise(F.col("value")))
    compared = compare.skipping(compare.fields(part, other, ["p_brand", "section", "p_partkey"]), 1, 2)
    return compare.verdict(compared, ["p_brand"])
