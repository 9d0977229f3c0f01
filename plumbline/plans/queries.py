"""Driver queries: each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.operators import atlas, calibrate, compare, evidence, metrics, regions
from plumbline.operators.evidence import Rule
from plumbline.plans.scratch import stash
from plumbline.sources import sample
from plumbline.sources.sample import Axis

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that it is held against."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lineitem as observations of y = quantity * (1 - discount), with y <= 42 required --------------------------------

BOUNDS = ((1.0, 50.0), (0.0, 0.1))
ROOT = ((1.0, 0.0), (50.0, 0.1))
SPLITS = (3, 2)


def y() -> Column:
    return F.get("y", F.lit(0))


def rules() -> list[Rule]:
    return [Rule(0, y(), "<=", F.lit(42.0)), Rule(1, F.get("x", F.lit(1)), "<", F.lit(0.095)), Rule(2, y(), "~", F.lit(40.0), 0.02), Rule(3, y(), "finite")]



OBS_SQL = """
obs AS (SELECT o * 64 + n AS id, q, d, q * (1 - d) AS y, n, o FROM (SELECT l_orderkey AS o, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount) AS n FROM lineitem))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation for each line, numbered n within its order o; the few lines of an order are a window's partition."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_discount"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), place.alias("n"))
    return lines.select((F.col("o") * 64 + F.col("n")).alias("id"), F.array("q", "d").alias("x"), F.array(F.col("q") * (1 - F.col("d"))).alias("y"), "o", "n")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a risk that rises towards the bound, facts where it is passed, and channel masks."""
    bad = y() > 42
    risk = F.when(bad, F.lit(1.0)).otherwise(F.pow(y() / 45, F.lit(8.0)))
    channels = F.when(bad, F.lit(2)).otherwise(F.lit(0)) + F.when(F.get("x", F.lit(1)) > 0.05, F.lit(16)).otherwise(F.lit(0))
    return observations(spark, sf_dir).select("id", "x", risk.alias("risk"), channels.alias("channels"), bad.alias("fact"), F.when(F.col("n") > 1, F.lit(18)).otherwise(F.lit(2)).alias("measured"))


POINTS_SQL = OBS_SQL + """,
pts AS (SELECT id, q, d, CASE WHEN y > 42 THEN 1.0::DOUBLE ELSE pow(y / 45, 8.0) END AS risk, (CASE WHEN y > 42 THEN 2 ELSE 0 END) + (CASE WHEN d > 0.05 THEN 16 ELSE 0 END) AS channels,
               y > 42 AS fact, CASE WHEN n > 1 THEN 18 ELSE 2 END AS measured FROM obs)"""
CELLS_SQL = POINTS_SQL + """,
binned AS (SELECT *, CAST(greatest(ceil((q - 1.0) / (49.0 / 8)) - 1, 0) AS INT) AS k0, CAST(greatest(ceil((d - 0.0) / (0.1 / 4)) - 1, 0) AS INT) AS k1 FROM pts WHERE q >= 1 AND q <= 50 AND d >= 0 AND d <= 0.1),
agg AS (SELECT k0, k1, count(*) AS samples, sum(risk) AS risk_sum, max(risk) AS risk_max, bit_or(channels) AS channels, bit_or(measured) AS measured, CAST(count(*) FILTER (fact) AS BIGINT) AS facts,
               bool_or(risk >= 0.45 AND (fact OR bit_count(channels) >= 2)) AS strong FROM binned GROUP BY k0, k1),
cells AS (SELECT *, CASE WHEN risk_max >= 0.7 OR risk_sum / samples >= 0.45 THEN CASE WHEN strong THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END
                    WHEN samples < 4 THEN 'UNKNOWN' WHEN bit_count(measured) < 1 THEN 'UNKNOWN' ELSE 'TRUSTED' END AS label,
                 1.0 + k0 * (49.0 / 8) AS lo0, 1.0 + (k0 + 1) * (49.0 / 8) AS hi0, 0.0 + k1 * (0.1 / 4) AS lo1, 0.0 + (k1 + 1) * (0.1 / 4) AS hi1, k0 * 4 + k1 AS cell FROM agg)"""


def cells(spark: SparkSession, sf_dir: str, policy: atlas.Policy = atlas.Policy()) -> DataFrame:
    made = atlas.grid_cells(points(spark, sf_dir), BOUNDS, SPLITS, policy=policy)
    number = (F.get("k", F.lit(0)) * 4 + F.get("k", F.lit(1))).cast("int")
    return made.withColumn("cell", number).withColumn("seq", number)


@query("WITH " + CELLS_SQL + " SELECT k0, k1, samples, round(risk_sum / samples, 9) AS mean_risk, round(risk_max, 9) AS risk_max, label FROM cells")
def cell_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select(F.get("k", F.lit(0)).alias("k0"), F.get("k", F.lit(1)).alias("k1"), "samples", F.round(atlas.mean_risk(), 9).alias("mean_risk"), F.round("risk_max", 9).alias("risk_max"), "label")


@query("WITH " + CELLS_SQL + " SELECT cell, samples, facts, channels, measured, bit_count(measured) AS channel_count, round(risk_sum, 6) AS risk_sum FROM cells")
def cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).select("cell", "samples", "facts", "channels", "measured", F.bit_count("measured").cast("tinyint").alias("channel_count"), F.round("risk_sum", 6).alias("risk_sum"))


@query("WITH " + CELLS_SQL + """ SELECT cell, CASE WHEN risk_max >= 0.7 OR risk_sum / samples >= 0.45 THEN CASE WHEN strong THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END WHEN samples < 4 THEN 'UNKNOWN'
  WHEN bit_count(measured) < 2 THEN 'UNKNOWN' WHEN samples / pow(0.5, 5) < 4000 THEN 'PROVISIONAL' ELSE 'TRUSTED' END AS label FROM cells""")
def cell_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = atlas.Policy(trust="both", resolution="withhold", certify="density", certify_density=4000.0)
    return cells(spark, sf_dir, policy).select("cell", "label")


@query("WITH " + CELLS_SQL + """ SELECT round(coalesce(sum((hi0 - lo0) / 49.0 * (hi1 - lo1) / 0.1) FILTER (label = 'TRUSTED'), 0), 9) AS trusted, round(coalesce(sum((hi0 - lo0) / 49.0 * (hi1 - lo1) / 0.1) FILTER (label = 'SUSPICIOUS'), 0), 9) AS suspicious,
  round(coalesce(sum((hi0 - lo0) / 49.0 * (hi1 - lo1) / 0.1) FILTER (label = 'UNKNOWN'), 0), 9) AS unknown, count(*) AS cells, CAST(sum(samples) AS BIGINT) AS samples FROM cells""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.coverage(cells(spark, sf_dir), ROOT).select(*[F.round(c, 9).alias(c) for c in ("trusted", "suspicious", "unknown")], "cells", "samples")


@query("WITH " + CELLS_SQL + """, known AS (SELECT *, CASE WHEN label = 'SUSPICIOUS' THEN 1 ELSE 2 END AS side FROM cells WHERE samples > 0 AND label <> 'UNKNOWN')
  SELECT DISTINCT a.cell FROM known a JOIN known b ON a.side <> b.side AND a.hi0 >= b.lo0 - 1e-12 AND b.hi0 >= a.lo0 - 1e-12 AND a.hi1 >= b.lo1 - 1e-12 AND b.hi1 >= a.lo1 - 1e-12""")
def disagreeing_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.disagreeing(cells(spark, sf_dir)).select("cell")


BANDS_SQL = CELLS_SQL + """,
known AS (SELECT *, CASE WHEN label = 'SUSPICIOUS' THEN 1 ELSE 2 END AS side FROM cells WHERE samples > 0 AND label <> 'UNKNOWN'),
pairs AS (SELECT a.lo0 AS al0, a.hi0 AS ah0, a.lo1 AS al1, a.hi1 AS ah1, b.lo0 AS bl0, b.hi0 AS bh0, b.lo1 AS bl1, b.hi1 AS bh1 FROM known a JOIN known b ON a.cell < b.cell AND a.side <> b.side),
bands AS (
  SELECT 0 AS axis, least(al0, bl0) AS lo, greatest(ah0, bh0) AS hi, least(ah0, bh0) AS facing_lo, greatest(al0, bl0) AS facing_hi FROM pairs
  WHERE (ah0 <= bl0 + 1e-12 OR bh0 <= al0 + 1e-12) AND ah1 >= bl1 - 1e-12 AND bh1 >= al1 - 1e-12
  UNION ALL
  SELECT 1, least(al1, bl1), greatest(ah1, bh1), least(ah1, bh1), greatest(al1, bl1) FROM pairs
  WHERE (ah1 <= bl1 + 1e-12 OR bh1 <= al1 + 1e-12) AND ah0 >= bl0 - 1e-12 AND bh0 >= al0 - 1e-12)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.raw_bands(cells(spark, sf_dir), 2)


@query("WITH " + BANDS_SQL + " SELECT axis, round(lo, 9) AS lo, round(hi, 9) AS hi, round(facing_lo, 9) AS facing_lo, round(facing_hi, 9) AS facing_hi FROM bands")
def neighbour_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(spark, sf_dir).select("axis", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "facing_lo", "facing_hi")])


MERGED_SQL = BANDS_SQL + """,
marked AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY axis ORDER BY lo, hi, facing_lo, facing_hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM bands),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY axis ORDER BY lo, hi, facing_lo, facing_hi ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT axis, min(lo) AS lo, max(hi) AS hi, min(facing_lo) AS facing_lo, max(facing_hi) AS facing_hi, count(*) AS transitions FROM islands GROUP BY axis, island)"""


@query("WITH " + MERGED_SQL + " SELECT axis, round(lo, 9) AS lo, round(hi, 9) AS hi, round(facing_lo, 9) AS facing_lo, round(facing_hi, 9) AS facing_hi, transitions FROM merged")
def merge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.merge_bands(bands(spark, sf_dir)).select("axis", *[F.round(c, 9).alias(c) for c in ("lo", "hi", "facing_lo", "facing_hi")], "transitions")


@query("WITH " + MERGED_SQL + """, declared(boundary, axis, pos, tolerance) AS (VALUES (0, 0, 42.0::DOUBLE, 3.0::DOUBLE), (1, 0, 10.0::DOUBLE, 1.0::DOUBLE), (2, 1, 0.03::DOUBLE, 0.05::DOUBLE)),
  vals AS (SELECT axis, unnest([facing_lo, facing_hi, (facing_lo + facing_hi) / 2]) AS v FROM merged)
  SELECT boundary, axis, round(min(abs(v - pos)), 9) AS miss, coalesce(min(abs(v - pos)) <= any_value(tolerance), false) AS hit FROM declared LEFT JOIN vals USING (axis) GROUP BY boundary, axis""")
def boundary_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = spark.createDataFrame([(0, 0, 42.0, 3.0), (1, 0, 10.0, 1.0), (2, 1, 0.03, 0.05)], "boundary int, axis int, at double, tolerance double")
    return regions.boundary_hits(atlas.merge_bands(bands(spark, sf_dir)), declared).select("boundary", "axis", F.round("miss", 9).alias("miss"), "hit")


@query("WITH " + CELLS_SQL + """, best AS (SELECT b.*, k0 * 4 + k1 AS cell FROM binned b QUALIFY row_number() OVER (PARTITION BY k0, k1 ORDER BY risk DESC, id) = 1)
  SELECT c.cell, best.id, round(best.risk, 9) AS risk, best.q, best.d FROM cells c JOIN best USING (cell) WHERE label = 'SUSPICIOUS'""")
def top_finding_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cells(spark, sf_dir)
    at = lambda i: F.greatest(F.ceil((F.get("x", F.lit(i)) - BOUNDS[i][0]) / F.lit((BOUNDS[i][1] - BOUNDS[i][0]) / (1 << SPLITS[i]))) - 1, F.lit(0))
    placed = points(spark, sf_dir).withColumn("cell", (at(0) * 4 + at(1)).cast("int"))
    found = atlas.findings(made, placed)
    return found.select("cell", "id", F.round("risk", 9).alias("risk"), F.get("x", F.lit(0)).alias("q"), F.get("x", F.lit(1)).alias("d"))


@query("WITH " + POINTS_SQL + """, root AS (SELECT count(*) AS samples, sum(risk) AS s, max(risk) AS m FROM pts WHERE q BETWEEN 1 AND 50 AND d BETWEEN 0 AND 0.1),
  half AS (SELECT CASE WHEN d <= 0.05 THEN 1 ELSE 2 END AS cell, risk FROM pts)
  SELECT cell, 1 AS depth, CASE cell WHEN 1 THEN 0.0 ELSE 0.05 END::DOUBLE AS lo1, CASE cell WHEN 1 THEN 0.05 ELSE 0.1 END::DOUBLE AS hi1, count(*) AS samples, round(sum(risk), 6) AS risk_sum FROM half GROUP BY cell""")
def refine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass of refinement from the whole space: equal relative widths, so the last axis is halved."""
    whole = spark.createDataFrame([(0, 0, 0, list(ROOT[0]), list(ROOT[1]))], "cell int, seq int, depth int, lo array<double>, hi array<double>")
    placed = points(spark, sf_dir).withColumn("cell", F.lit(0))
    leaves, moved = atlas.refine(atlas.filed(placed, whole), placed, ROOT)
    return atlas.filed(moved, leaves).select("cell", "depth", F.get("lo", F.lit(1)).alias("lo1"), F.get("hi", F.lit(1)).alias("hi1"), "samples", F.round("risk_sum", 6).alias("risk_sum"))


@query("WITH " + CELLS_SQL + """ SELECT p.id, min(c.cell) AS cell FROM pts p LEFT JOIN cells c ON p.q BETWEEN c.lo0 AND c.hi0 AND p.d BETWEEN c.lo1 AND c.hi1 GROUP BY p.id""")
def locate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join: each point with the first closed cell that holds it."""
    return atlas.locate(points(spark, sf_dir), cells(spark, sf_dir), span=BOUNDS[0]).select("id", "cell")


REGIONS = [(0, [40.0, 0.0], [50.0, 0.06]), (1, [44.0, 0.03], [50.0, 0.1]), (2, [1.0, 0.0], [3.0, 0.02])]
REGIONS_SQL = """
reg(region, rl0, rl1, rh0, rh1) AS (VALUES (0, 40.0::DOUBLE, 0.0::DOUBLE, 50.0::DOUBLE, 0.06::DOUBLE), (1, 44.0, 0.03, 50.0, 0.1), (2, 1.0, 0.0, 3.0, 0.02))"""


def truth(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region int, lo array<double>, hi array<double>")


TOUCH_SQL = "c.hi0 >= rl0 AND c.lo0 <= rh0 AND c.hi1 >= rl1 AND c.lo1 <= rh1"
SHARE_SQL = "greatest(least(c.hi0, rh0) - greatest(c.lo0, rl0), 0) * greatest(least(c.hi1, rh1) - greatest(c.lo1, rl1), 0) / ((c.hi0 - c.lo0) * (c.hi1 - c.lo1))"


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + f" SELECT DISTINCT region FROM reg JOIN cells c ON {TOUCH_SQL} WHERE label = 'SUSPICIOUS'")
def region_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.detected(truth(spark), cells(spark, sf_dir)).select("region")


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + f" SELECT DISTINCT region FROM reg JOIN cells c ON {TOUCH_SQL} WHERE label = 'SUSPICIOUS' AND {SHARE_SQL} >= 0.5")
def region_localised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.detected(truth(spark), cells(spark, sf_dir), least=regions.LOCALISED).select("region")


@query("WITH " + CELLS_SQL + "," + REGIONS_SQL + f" SELECT cell, region, round({SHARE_SQL}, 9) AS overlap FROM reg JOIN cells c ON {TOUCH_SQL}")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.overlaps(cells(spark, sf_dir), truth(spark)).select("cell", "region", F.round("overlap", 9).alias("overlap"))


UNION_SQL = CELLS_SQL + "," + REGIONS_SQL + """,
each AS (SELECT cell, sum(w0 * w1) AS covered FROM (
    SELECT c.cell, greatest(least(c.hi0, rh0) - greatest(c.lo0, rl0), 0) AS w0, greatest(least(c.hi1, rh1) - greatest(c.lo1, rl1), 0) AS w1 FROM cells c, reg) GROUP BY cell),
twice AS (SELECT c.cell, greatest(least(c.hi0, 50.0) - greatest(c.lo0, 44.0), 0) * greatest(least(c.hi1, 0.06) - greatest(c.lo1, 0.03), 0) AS common FROM cells c),
shares AS (SELECT c.cell, c.label, (c.hi0 - c.lo0) * (c.hi1 - c.lo1) AS v, (covered - common) / ((c.hi0 - c.lo0) * (c.hi1 - c.lo1)) AS overlap FROM cells c JOIN each USING (cell) JOIN twice USING (cell))"""


@query("WITH " + UNION_SQL + " SELECT cell, round(overlap, 9) AS overlap FROM shares")
def union_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.union_overlap(cells(spark, sf_dir), truth(spark), axes=2).select("cell", F.round("overlap", 9).alias("overlap"))


@query("WITH " + UNION_SQL + " SELECT round(1 - sum(v * overlap) / sum(v), 9) AS false_positive FROM shares WHERE label = 'SUSPICIOUS'")
def false_positive_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cells(spark, sf_dir)
    return regions.false_positive(made, regions.union_overlap(made, truth(spark), axes=2)).select(F.round("false_positive", 9).alias("false_positive"))


@query("WITH " + OBS_SQL + "," + REGIONS_SQL + """ SELECT region, count(*) AS points, min(id) AS first_id FROM obs JOIN reg ON q BETWEEN rl0 AND rh0 AND d BETWEEN rl1 AND rh1 GROUP BY region""")
def region_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.contains(truth(spark), observations(spark, sf_dir)).groupBy("region").agg(F.count("*").alias("points"), F.min("id").alias("first_id"))


@query("WITH " + OBS_SQL + "," + REGIONS_SQL + """ SELECT id, round(min(greatest(rl0 - q, q - rh0, 0) / 49.0 + greatest(rl1 - d, d - rh1, 0) / 0.1), 9) AS margin FROM obs, reg GROUP BY id""")
def region_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.margin(observations(spark, sf_dir), truth(spark), ROOT).select("id", F.round("margin", 9).alias("margin"))


# ---- evidence --------------------------------------------------------------------------------------------------------

CONSTRAINTS_SQL = OBS_SQL + """,
found AS (
  SELECT id, o, 'require0' AS subject, abs(y - 42.0) / greatest(abs(y), 42.0, 1.0) AS magnitude FROM obs WHERE NOT y <= 42
  UNION ALL SELECT id, o, 'require1', abs(d - 0.095) / 1.0 FROM obs WHERE NOT d < 0.095
  UNION ALL SELECT id, o, 'require2', abs(y - 40.0) / (0.02 * 40.0) - 1 FROM obs WHERE abs(y - 40.0) / (0.02 * 40.0) > 1)"""


@query("WITH " + CONSTRAINTS_SQL + " SELECT id, subject, round(magnitude, 9) AS magnitude, 1.0::DOUBLE AS strength FROM found")
def constraint_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.constraints(observations(spark, sf_dir), rules()).select(F.get("observations", F.lit(0)).alias("id"), "subject", F.round("magnitude", 9).alias("magnitude"), "strength")


@query("WITH " + OBS_SQL + """ SELECT id, round(least((42.0 - y) / greatest(abs(y), 42.0, 1.0), (0.095 - d) / 1.0, (0.8 - abs(y - 40.0)) / 0.8, 1.0), 9) AS level,
  y > 42 OR d >= 0.095 OR abs(y - 40.0) / 0.8 > 1 AS violates FROM obs""")
def level_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("id", F.round(evidence.level(rules()), 9).alias("level"), evidence.violates(rules(), F.col("y")).alias("violates"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS id, subject, strength FROM lineitem, (VALUES ('o0:divergent', 0), ('o1:divergent', 1)) v(subject, n),
  LATERAL (SELECT CASE WHEN n = 0 THEN CASE WHEN l_discount = 0 THEN 0.9 END WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.9 END END::DOUBLE AS strength) WHERE strength IS NOT NULL""")
def divergence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(ieee.div(F.col("l_extendedprice"), F.col("l_discount")), ieee.div(F.col("l_discount"), F.col("l_tax"))).alias("y"))
    return evidence.divergence(rows).select(F.get("observations", F.lit(0)).alias("id"), "subject", "strength")


PROBES_SQL = OBS_SQL + """,
pairs AS (SELECT a.id AS base, b.id AS perturbed, a.o, a.q AS x0, b.q AS x1, a.y AS y0, b.y AS y1 FROM obs a JOIN obs b ON a.o = b.o AND a.n + 1 = b.n),
sl AS (SELECT *, abs(y1 - y0) / abs(x1 - x0) AS slope FROM pairs WHERE x0 <> x1)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe pairs along quantity: each line with the next of its order."""
    return values_of(observations(spark, sf_dir))


def values_of(obs: DataFrame) -> DataFrame:
    following = F.lead("id").over(Window.partitionBy("o").orderBy("n"))
    pairs = obs.select(F.col("id").alias("base"), following.alias("perturbed"), F.lit(0).alias("axis")).where("perturbed is not null")
    return evidence.probe_values(obs, pairs)


@query("WITH " + PROBES_SQL + " SELECT base, perturbed, round(slope, 9) AS slope FROM sl")
def probe_pairs_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.slopes(values(spark, sf_dir)).select("base", "perturbed", F.round("slope", 9).alias("slope"))


@query("WITH " + PROBES_SQL + " SELECT 0 AS axis, 0 AS output, round(median(slope), 9) AS typical FROM sl")
def slope_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.slope_reference(values(spark, sf_dir)).select("axis", "output", F.round("typical", 9).alias("typical"))


@query("WITH " + PROBES_SQL + ", t AS (SELECT median(slope) AS m FROM sl) SELECT base, perturbed, 'o0~p0:slope' AS subject, round(slope / m - 1, 9) AS magnitude FROM sl, t WHERE slope / m > 1.5")
def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.sensitivity(values(spark, sf_dir))
    return found.select(F.get("observations", F.lit(0)).alias("base"), F.get("observations", F.lit(1)).alias("perturbed"), "subject", F.round("magnitude", 9).alias("magnitude"))


STEPS_SQL = PROBES_SQL + ", st AS (SELECT *, abs(y1 - y0) / greatest(abs(y0), abs(y1), 1.0) AS rel, y1 < y0 AS wrong FROM pairs)"


@query("WITH " + STEPS_SQL + """ SELECT 'check0' AS subject, round(CAST(count(*) FILTER (wrong) AS DOUBLE) / count(*) * max(rel) FILTER (wrong), 9) AS magnitude,
  (SELECT count(DISTINCT i) FROM (SELECT unnest([base, perturbed]) AS i FROM st WHERE wrong)) AS offenders FROM st""")
def monotone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = values(spark, sf_dir)
    named = evidence.monotone_offenders(pairs, 0, 0, 0).groupBy("subject").agg(F.count("*").alias("offenders"))
    return evidence.monotone_check(pairs, 0, 0, 0).join(named, "subject").select("subject", F.round("magnitude", 9).alias("magnitude"), "offenders")


@query("WITH " + STEPS_SQL + """ SELECT count(*) FILTER (wrong) AS violated, count(*) AS total, round(max(rel) FILTER (wrong), 9) AS worst, round(abs(ln(median(rel) FILTER (wrong) / median(rel))), 9) AS severity FROM st""")
def monotony_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.monotony(values(spark, sf_dir)).select("violated", "total", F.round("worst", 9).alias("worst"), F.round("severity", 9).alias("severity"))


@query("WITH " + PROBES_SQL + """, e AS (SELECT base, perturbed, (ln(y1) - ln(y0)) / (ln(x1) - ln(x0)) AS e FROM pairs WHERE least(x0, x1, y0, y1) > 0 AND abs(ln(x1) - ln(x0)) >= 1e-12)
  SELECT 'check1' AS subject, round(abs(avg(e) - 2.0), 6) AS magnitude, (SELECT count(DISTINCT i) FROM (SELECT unnest([base, perturbed]) AS i FROM e WHERE abs(e - 2.0) >= abs((SELECT avg(e) FROM e) - 2.0) * 0.5)) AS offenders FROM e""")
def scales_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = values(spark, sf_dir)
    named = evidence.scale_offenders(pairs, 1, 0, 0, 2.0).groupBy("subject").agg(F.count("*").alias("offenders"))
    return evidence.scales_as(pairs, 1, 0, 0, 2.0).join(named, "subject").select("subject", F.round("magnitude", 6).alias("magnitude"), "offenders")


@query("WITH " + PROBES_SQL + """ SELECT 'check2' AS subject, round(max(slope) / 0.9, 9) AS magnitude, (SELECT count(DISTINCT i) FROM (SELECT unnest([base, perturbed]) AS i FROM sl WHERE slope > 0.9)) AS offenders FROM sl HAVING max(slope) > 0.9""")
def lipschitz(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = values(spark, sf_dir)
    named = evidence.steep_offenders(pairs, 2, 0, 0, 0.9).groupBy("subject").agg(F.count("*").alias("offenders"))
    return evidence.lipschitz(pairs, 2, 0, 0, 0.9).join(named, "subject").select("subject", F.round("magnitude", 9).alias("magnitude"), "offenders")


@query("""WITH p AS (SELECT a.p_partkey AS base, b.p_partkey AS swapped, a.p_retailprice AS u, b.p_retailprice AS v FROM part a JOIN part b ON a.p_partkey + 1 = b.p_partkey)
  SELECT base, swapped, round(abs(u - v) / greatest(abs(u), abs(v)), 9) AS magnitude FROM p WHERE u <> v""")
def symmetry_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    obs = part.select(F.col("p_partkey").alias("id"), F.array("p_retailprice").alias("y"))
    swaps = part.select(F.col("p_partkey").alias("base"), (F.col("p_partkey") + 1).alias("swapped"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    found = evidence.symmetric(obs, swaps, 3, 0)
    return found.select(F.get("observations", F.lit(0)).alias("base"), F.get("observations", F.lit(1)).alias("swapped"), F.round("magnitude", 9).alias("magnitude"))


@query("""WITH t AS (SELECT user_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events)
  SELECT user_id, round(max(abs(value - f) / abs(f)) / 0.001, 6) AS magnitude FROM t WHERE f <> 0 GROUP BY user_id HAVING max(abs(value - f) / abs(f)) > 0.001""")
def conserved_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("trace"))
    obs = traces.select(F.col("user_id").alias("id"), F.array("trace").alias("traces"))
    return evidence.conserved(obs, 4, 0).select(F.get("observations", F.lit(0)).alias("user_id"), F.round("magnitude", 6).alias("magnitude"))


#: y and z (both positive) are more than one representable step apart.
STEPS_APART = "abs(y - z) > pow(2, floor(log2(least(y, z)))) * 2.220446049250313e-16"
F32_SQL = OBS_SQL + ", f AS (SELECT id, o, y, CAST(CAST(q AS FLOAT) * CAST(CAST(1 AS FLOAT) - CAST(d AS FLOAT) AS FLOAT) AS DOUBLE) AS z FROM obs)"


def reduced(obs: DataFrame) -> DataFrame:
    q, d = F.get("x", F.lit(0)).cast("float"), F.get("x", F.lit(1)).cast("float")
    return obs.select("id", F.array((q * (F.lit(1).cast("float") - d).cast("float")).cast("float").cast("double")).alias("y"))


@query("WITH " + F32_SQL + " SELECT id, round(abs(y - z) / greatest(abs(y), abs(z)) * 1e6, 6) AS millionths FROM f WHERE " + STEPS_APART)
def numerical_f32(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    found = evidence.path_gap(obs, reduced(obs))
    return found.select(F.get("observations", F.lit(0)).alias("id"), F.round(F.col("magnitude") * 1e6, 6).alias("millionths"))


# ---- calibration and fusion: evidence of three channels, sets by order -----------------------------------------------

ALL_SQL = CONSTRAINTS_SQL + """,
pairs AS (SELECT a.id AS base, b.id AS perturbed, a.o, abs(b.y - a.y) / abs(b.q - a.q) AS slope FROM obs a JOIN obs b ON a.o = b.o AND a.n + 1 = b.n WHERE a.q <> b.q),
f32 AS (SELECT id, o, y, CAST(CAST(q AS FLOAT) * CAST(CAST(1 AS FLOAT) - CAST(d AS FLOAT) AS FLOAT) AS DOUBLE) AS z FROM obs),
ev AS (
  SELECT o, 'Physical' AS channel, subject, magnitude, 1.0::DOUBLE AS strength, [id] AS ids, true AS fixed FROM found
  UNION ALL SELECT o, 'Sensitivity', 'o0~p0:slope', slope / m - 1, 0.0, [base, perturbed], false FROM pairs, (SELECT median(slope) AS m FROM pairs) WHERE slope / m > 1.5
  UNION ALL SELECT o, 'Numerical', 'o0~p65535:continuous', abs(y - z) / greatest(abs(y), abs(z)), 0.0, [id, -1 - id], false FROM f32 WHERE """ + STEPS_APART + """),
chan AS (SELECT channel, greatest(median(magnitude), CASE channel WHEN 'Numerical' THEN 1e-6 ELSE 1e-12 END) AS scale FROM ev WHERE magnitude > 0 GROUP BY channel),
claim AS (SELECT channel, subject, greatest(median(magnitude), CASE channel WHEN 'Numerical' THEN 1e-6 ELSE 1e-12 END) AS scale FROM ev WHERE magnitude > 0 GROUP BY channel, subject HAVING count(*) >= 8),
cal AS (SELECT ev.* REPLACE (CASE WHEN fixed THEN strength WHEN magnitude > coalesce(claim.scale, chan.scale, 1.0) THEN 1 - exp(-(magnitude / coalesce(claim.scale, chan.scale, 1.0) - 1)) ELSE 0 END AS strength)
  FROM ev LEFT JOIN chan USING (channel) LEFT JOIN claim USING (channel, subject)),
top AS (SELECT o, coalesce(max(strength) FILTER (channel = 'Physical'), 0) AS p, coalesce(max(strength) FILTER (channel = 'Numerical'), 0) AS n, coalesce(max(strength) FILTER (channel = 'Sensitivity'), 0) AS s FROM cal GROUP BY o),
rho AS (
  SELECT CASE WHEN isnan(corr(p, n)) THEN 0 ELSE greatest(0, least(1, corr(p, n))) END AS pn, CASE WHEN isnan(corr(p, s)) THEN 0 ELSE greatest(0, least(1, corr(p, s))) END AS ps, CASE WHEN isnan(corr(n, s)) THEN 0 ELSE greatest(0, least(1, corr(n, s))) END AS ns FROM top)"""


def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical, sensitivity and numerical items with their order o as the set; written, as several steps read it."""
    obs = stash(observations(spark, sf_dir), "observations")
    found = evidence.constraints(obs, rules()).unionByName(evidence.sensitivity(values_of(obs))).unionByName(evidence.path_gap(obs, reduced(obs)))
    return stash(found.withColumn("o", F.floor(F.get("observations", F.lit(0)) / 64)), "evidence")


def strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_evidence(spark, sf_dir)
    return stash(calibrate.calibrated(found, calibrate.channel_scale(found), calibrate.claim_scale(found)), "strengths")


@query("WITH " + ALL_SQL + " SELECT channel, round(scale, 9) AS scale FROM chan")
def channel_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.channel_scale(all_evidence(spark, sf_dir)).select("channel", F.round("scale", 9).alias("scale"))


@query("WITH " + ALL_SQL + " SELECT channel, subject, round(scale, 9) AS scale FROM claim")
def claim_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.claim_scale(all_evidence(spark, sf_dir)).select("channel", "subject", F.round("scale", 9).alias("scale"))


@query("WITH " + ALL_SQL + " SELECT ids[1] AS id, channel, subject, round(strength, 6) AS strength, CASE WHEN strength >= 0.75 THEN 'HIGH' WHEN strength >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM cal")
def strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = strengths(spark, sf_dir)
    return s.select(F.get("observations", F.lit(0)).alias("id"), "channel", "subject", F.round("strength", 6).alias("strength"), calibrate.confidence(F.col("strength")).alias("confidence"))


@query("WITH " + ALL_SQL + """ SELECT a, b, round(CASE a || b WHEN 'PhysicalNumerical' THEN pn WHEN 'PhysicalSensitivity' THEN ps WHEN 'NumericalSensitivity' THEN ns ELSE 0 END, 6) AS rho
  FROM (VALUES ('Behavioral', 0), ('Physical', 1), ('Numerical', 2), ('Differential', 3), ('Sensitivity', 4)) x(a, i) JOIN (VALUES ('Behavioral', 0), ('Physical', 1), ('Numerical', 2), ('Differential', 3), ('Sensitivity', 4)) y(b, j) ON i < j, rho""")
def channel_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = calibrate.strongest(strengths(spark, sf_dir), ["o"])
    return calibrate.channel_correlation(sets).select("a", "b", F.round("rho", 6).alias("rho"))


FUSE_SQL = ALL_SQL + """,
by_channel AS (SELECT o, channel, max(strength) AS strength, flatten(list(ids)) AS ids, CASE channel WHEN 'Physical' THEN 1 WHEN 'Numerical' THEN 2 ELSE 4 END AS place FROM cal GROUP BY o, channel HAVING max(strength) > 0),
ranked AS (SELECT *, row_number() OVER w AS rank, flatten(list(ids) OVER (PARTITION BY o ORDER BY strength DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS theirs FROM by_channel WINDOW w AS (PARTITION BY o ORDER BY strength DESC, place)),
known AS (SELECT x.o, x.channel, max(CASE WHEN least(x.place, y.place) = 1 AND greatest(x.place, y.place) = 2 THEN pn WHEN least(x.place, y.place) = 1 THEN ps ELSE ns END) AS rho
  FROM ranked x JOIN ranked y ON x.o = y.o AND y.rank < x.rank, rho GROUP BY x.o, x.channel),
parts AS (SELECT r.o, r.channel, r.rank, strength, CASE WHEN theirs IS NULL OR len(theirs) = 0 THEN 0.0 ELSE (
    CASE WHEN len(list_filter(ids, lambda i: list_contains(theirs, i))) = 0 THEN 0.0
         WHEN len(list_filter(ids, lambda i: list_contains(theirs, i))) / len(list_distinct(list_concat(ids, theirs))) >= 0.999 THEN 0.95
         ELSE 0.5 * len(list_filter(ids, lambda i: list_contains(theirs, i))) / len(list_distinct(list_concat(ids, theirs))) END) END AS common, coalesce(known.rho, 0) AS rho
  FROM ranked r LEFT JOIN known ON r.o = known.o AND r.channel = known.channel),
acc AS (SELECT *, strength * (1 - least(greatest(rho, common), 0.95)) AS accepted FROM parts)"""


@query("WITH " + FUSE_SQL + " SELECT o, round(1 - product(1 - accepted), 6) AS score, count(*) AS channels, arg_max(channel, (round(accepted, 12), rank)) AS dominant FROM acc GROUP BY o")
def fuse_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strengths(spark, sf_dir)
    rho = calibrate.channel_correlation(calibrate.strongest(found, ["o"]))
    risk = calibrate.fused(found, ["o"], rho)
    return risk.select("o", F.round("score", 6).alias("score"), F.size("contributions").cast("long").alias("channels"), "dominant")


@query("WITH " + ALL_SQL + " SELECT i AS id, count(*) AS items, round(max(strength), 6) AS strongest FROM (SELECT unnest(ids) AS i, strength FROM cal) GROUP BY i")
def own_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.own_evidence(strengths(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("items"), F.round(F.max("strength"), 6).alias("strongest"))


@query("WITH " + ALL_SQL + " SELECT o, array_to_string(list_sort(list_distinct(list(channel || '|' || subject))), ',') AS signature FROM cal WHERE strength >= 0.5 GROUP BY o")
def finding_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return atlas.signature(strengths(spark, sf_dir), ["o"]).select("o", F.array_join("signature", ",").alias("signature"))


@query("WITH " + ALL_SQL + " SELECT channel, count(*) AS readings, count(*) FILTER (strength >= 0.5) AS strong, count(*) FILTER (strength <= 0) AS silenced FROM cal GROUP BY channel")
def channel_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.census(strengths(spark, sf_dir))


@query("WITH " + ALL_SQL + " SELECT channel, count(*) AS items FROM ev WHERE channel <> 'Physical' GROUP BY channel")
def ablation_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.without_channels(all_evidence(spark, sf_dir), ["Physical"]).groupBy("channel").agg(F.count("*").alias("items"))


@query("""SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM supplier t WHERE t.s_acctbal >= s.s_acctbal AND t.s_nationkey >= s.s_nationkey AND (t.s_acctbal > s.s_acctbal OR t.s_nationkey > s.s_nationkey))""")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.pareto_front(read(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"]).select("s_suppkey", "s_acctbal", "s_nationkey")


@query("""SELECT p_partkey FROM part s WHERE NOT EXISTS (SELECT 1 FROM part t WHERE t.p_size >= s.p_size AND t.p_retailprice >= s.p_retailprice AND t.p_partkey >= s.p_partkey AND (t.p_size > s.p_size OR t.p_retailprice > s.p_retailprice OR t.p_partkey > s.p_partkey))""")
def pareto_front_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.pareto_front(read(spark, sf_dir, "part"), ["p_size", "p_retailprice", "p_partkey"]).select("p_partkey")


# ---- arithmetic and generators ---------------------------------------------------------------------------------------


def shown(v: Column, digits: int = 9) -> Column:
    """A double as text that tells NaN and infinities."""
    return F.when(F.isnan(v), "nan").when(v == ieee.INF, "inf").when(v == -ieee.INF, "-inf").otherwise(F.format_string(f"%.{digits}f", v + F.lit(0.0)))


def shown_sql(v: str, digits: int = 9) -> str:
    return f"CASE WHEN isnan({v}) THEN 'nan' WHEN {v} = 'inf'::DOUBLE THEN 'inf' WHEN {v} = '-inf'::DOUBLE THEN '-inf' ELSE printf('%.{digits}f', ({v}) + 0.0) END"


AB_SQL = "(SELECT p_partkey, CAST(p_size % 7 - 3 AS DOUBLE) * 0.5 AS a, CAST(p_partkey % 5 - 2 AS DOUBLE) AS b FROM part)"


@query(f"""SELECT p_partkey, {shown_sql('a / b')} AS div, {shown_sql('CASE WHEN a > 0 THEN ln(a) WHEN a = 0 THEN -inf ELSE nan END'.replace('-inf', "'-inf'::DOUBLE").replace('nan', "'nan'::DOUBLE"))} AS ln,
  {shown_sql("CASE WHEN b = 0 THEN 'nan'::DOUBLE ELSE a - abs(b) * floor(a / abs(b)) END")} AS rem, {shown_sql('least(a, b)')} AS low, {shown_sql('greatest(a, b)')} AS high,
  {shown_sql('floor(a)')} AS floor, {shown_sql('ceil(a)')} AS ceil, {shown_sql('trunc(a)')} AS trunc, {shown_sql('round(a)')} AS round,
  a < b AS lt, a = b AS eq, abs(a - b) <= 0.5 * greatest(abs(b), 1.0) AS approx FROM {AB_SQL}""")
def ieee_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") % 7 - 3).cast("double") * 0.5).alias("a"), (F.col("p_partkey") % 5 - 2).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    each = {"div": ieee.div(a, b), "ln": ieee.ln(a), "rem": ieee.rem(a, b), "low": ieee.fmin(a, b), "high": ieee.fmax(a, b), "floor": ieee.floor(a), "ceil": ieee.ceil(a), "trunc": ieee.trunc(a), "round": ieee.round_half_away(a)}
    return rows.select("p_partkey", *[shown(v).alias(k) for k, v in each.items()], ieee.lt(a, b).alias("lt"), ieee.eq(a, b).alias("eq"), ieee.approx(a, b, 0.5).alias("approx"))


@query("""SELECT p_partkey, round(sin(x), 9) AS sin, round(cos(x), 9) AS cos, round(tan(x), 9) AS tan, round(atan(x), 9) AS atan, round(asin(1 / (1 + x)), 9) AS asin, round(acos(1 / (1 + x)), 9) AS acos, round(atan2(x, 2.0), 9) AS atan2,
  round((exp(x) - exp(-x)) / 2, 6) AS sinh, round((exp(x) + exp(-x)) / 2, 6) AS cosh, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 9) AS tanh, round(exp(-x), 9) AS exp, round(log2(1 + x), 9) AS log2, round(log10(1 + x), 9) AS log10,
  round(sqrt(x), 9) AS sqrt, round(cbrt(x), 9) AS cbrt, round(sqrt(x * x + 4), 9) AS hypot, round(pow(x, 1.5), 6) AS pow, round(greatest(1.0, least(3.0, x)), 9) AS clamp, round(1 + (x - 1) * 0.25, 9) AS lerp
  FROM (SELECT p_partkey, p_size / 10.0::DOUBLE AS x FROM part)""")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    one = F.lit(1.0)
    each = {
        "sin": F.sin(x), "cos": F.cos(x), "tan": F.tan(x), "atan": F.atan(x), "asin": F.asin(one / (1 + x)), "acos": F.acos(one / (1 + x)), "atan2": F.atan2(x, F.lit(2.0)), "tanh": F.tanh(x), "exp": F.exp(-x), "log2": ieee.log2(1 + x), "log10": ieee.log10(1 + x),
        "sqrt": F.sqrt(x), "cbrt": F.cbrt(x), "hypot": F.hypot(x, F.lit(2.0)), "clamp": ieee.clamp(x, one, F.lit(3.0)), "lerp": ieee.lerp(one, x, F.lit(0.25)),
    }
    coarse = {"sinh": F.sinh(x), "cosh": F.cosh(x), "pow": F.pow(x, F.lit(1.5))}
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(10.0)).alias("x"))
    return rows.select("p_partkey", *[F.round(v, 9).alias(k) for k, v in each.items()], *[F.round(v, 6).alias(k) for k, v in coarse.items()])


@query("""SELECT p_partkey, round(1.0 + 49.0 * u, 9) AS value, round((1.0 + 49.0 * u - 1.0) / 49.0, 9) AS back, [2.0::DOUBLE, 3.0, 5.0, 7.0][CAST(least(floor(u * 4), 3) AS INT) + 1] AS choice, (least(floor(u * 4), 3) + 0.5) / 4 AS choice_back FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS u FROM part)""")
def unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    interval, choice = Axis("v", 1.0, 50.0), Axis("c", choices=(2.0, 3.0, 5.0, 7.0))
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(50.0)).alias("u"))
    made = rows.withColumn("v", sample.from_unit(F.col("u"), interval)).withColumn("choice", sample.from_unit(F.col("u"), choice))
    return made.select("p_partkey", F.round("v", 9).alias("value"), F.round(sample.to_unit(F.col("v"), interval), 9).alias("back"), "choice", sample.to_unit(F.col("choice"), choice).alias("choice_back"))


@query("WITH " + OBS_SQL + """ SELECT id, axis, round(CASE WHEN axis = 0 THEN CASE WHEN q - 1.0 >= 1e-4 * 49 AND 50.0 - q < 1e-4 * 49 THEN q - 1e-4 * 49 ELSE q + 1e-4 * 49 END ELSE q END, 9) AS q,
  round(CASE WHEN axis = 1 THEN CASE WHEN d - 0.0 >= 1e-4 * 0.1 AND 0.1 - d < 1e-4 * 0.1 THEN d - 1e-4 * 0.1 ELSE d + 1e-4 * 0.1 END ELSE d END, 9) AS d
  FROM obs, (VALUES (0), (1)) v(axis)""")
def probe_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sample.probe_star(observations(spark, sf_dir), [Axis("q", *BOUNDS[0]), Axis("d", *BOUNDS[1])])
    return made.select(F.col("base").alias("id"), "axis", F.round(F.get("x", F.lit(0)), 9).alias("q"), F.round(F.get("x", F.lit(1)), 9).alias("d"))


# ---- outcomes: orders as campaigns, budgets by priority --------------------------------------------------------------

OUTCOMES_SQL = """
oc AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS entry, CASE o_orderkey % 3 WHEN 0 THEN 'adaptive' WHEN 1 THEN 'random' ELSE 'stratified' END AS strategy, o_custkey % 3 AS seed,
  CAST(substr(o_orderpriority, 1, 1) AS INT) * 40 AS budget, CASE WHEN o_custkey % 20 < 15 THEN 2 ELSE 0 END AS declared_regions,
  max(CASE WHEN o_totalprice > 150000 THEN CASE WHEN o_totalprice > 300000 THEN 2 ELSE 1 END ELSE 0 END) AS localised_regions, max(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS detected_regions,
  avg(CASE WHEN o_totalprice > 350000 THEN 0.25 ELSE 0.0 END) AS suspicious, count(*) AS evaluations FROM orders GROUP BY ALL)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    strategy = F.when(F.col("o_orderkey") % 3 == 0, "adaptive").when(F.col("o_orderkey") % 3 == 1, "random").otherwise("stratified")
    keyed = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).cast("string").alias("entry"), strategy.alias("strategy"), (F.col("o_custkey") % 3).alias("seed"), (F.substring("o_orderpriority", 1, 1).cast("int") * 40).alias("budget"), F.when(F.col("o_custkey") % 20 < 15, 2).otherwise(0).alias("declared_regions"), price.alias("price"))
    return keyed.groupBy("entry", "strategy", "seed", "budget", "declared_regions").agg(
        F.max(F.when(F.col("price") > 300000, 2).when(F.col("price") > 150000, 1).otherwise(0)).alias("localised_regions"), F.max(F.when(F.col("price") > 100000, 1).otherwise(0)).alias("detected_regions"),
        F.avg(F.when(F.col("price") > 350000, 0.25).otherwise(0.0)).alias("suspicious"), F.count("*").alias("evaluations"))


LADDER_SQL = OUTCOMES_SQL + """,
bad AS (SELECT *, max(CASE WHEN suspicious > 0 THEN budget END) OVER (PARTITION BY entry, strategy, seed) AS last_bad FROM oc),
ladder AS (SELECT entry, strategy, seed, min(budget) FILTER (declared_regions > 0 AND detected_regions > 0) AS detected_at, min(budget) FILTER (declared_regions > 0 AND localised_regions = declared_regions) AS localised_at,
  min(budget) FILTER (declared_regions = 0 AND budget > coalesce(last_bad, -1)) AS clean_at FROM bad GROUP BY entry, strategy, seed)"""


@query("WITH " + LADDER_SQL + " SELECT * FROM ladder")
def sweep_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ladder(outcomes(spark, sf_dir))


@query("WITH " + LADDER_SQL + """, v AS (SELECT entry, seed, min(coalesce(localised_at, 1000000000)) FILTER (strategy = 'adaptive') AS m, min(coalesce(localised_at, 1000000000)) FILTER (strategy <> 'adaptive') AS t FROM ladder GROUP BY entry, seed)
  SELECT entry, seed, CASE WHEN m < t THEN 'win' WHEN m > t THEN 'loss' ELSE 'tie' END AS verdict FROM v""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.verdict(metrics.ladder(outcomes(spark, sf_dir))).select("entry", "seed", "verdict")


ARMS_SQL = OUTCOMES_SQL + """,
met AS (SELECT f.localised_regions >= 1 AS f, a.localised_regions >= 2 AS a, f.entry IS NOT NULL AND a.entry IS NOT NULL AS paired FROM (SELECT * FROM oc WHERE seed < 2) f FULL JOIN (SELECT * FROM oc WHERE seed > 0) a USING (entry, strategy, seed, budget))"""


@query("WITH " + ARMS_SQL + """ SELECT count(*) FILTER (paired AND f AND NOT a) AS full_only, count(*) FILTER (paired AND a AND NOT f) AS arm_only, count(*) FILTER (paired AND f AND a) AS both, count(*) FILTER (paired AND NOT f AND NOT a) AS neither,
  count(*) FILTER (paired AND (f IS NULL OR a IS NULL)) AS not_applicable, count(*) FILTER (NOT paired) AS unpaired FROM met""")
def ablation_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = outcomes(spark, sf_dir)
    return metrics.ablation(oc.where("seed < 2").withColumn("localised", F.col("localised_regions") >= 1), oc.where("seed > 0").withColumn("localised", F.col("localised_regions") >= 2))


@query("WITH " + OUTCOMES_SQL + " SELECT entry, strategy, localised_regions, evaluations, seed, budget FROM oc QUALIFY row_number() OVER (PARTITION BY entry, strategy ORDER BY localised_regions DESC, evaluations DESC, seed DESC, budget DESC) = 1")
def best_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_rows(outcomes(spark, sf_dir), ["localised_regions", "evaluations", "seed", "budget"])


@query("WITH " + OUTCOMES_SQL + " SELECT entry, budget, count(*) AS rows, CAST(sum(evaluations) AS BIGINT) AS evaluations, round(avg(suspicious), 9) AS suspicious FROM oc GROUP BY GROUPING SETS ((entry), (budget), ())")
def grouped_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.grouped(outcomes(spark, sf_dir), [["entry"], ["budget"], []], [F.count("*").alias("rows"), F.sum("evaluations").alias("evaluations"), F.round(F.avg("suspicious"), 9).alias("suspicious")])


@query("WITH " + OUTCOMES_SQL + """ SELECT b.entry, count(*) AS pairs, round(avg(b.evaluations - a.evaluations), 9) AS delta FROM oc a JOIN oc b USING (entry, seed, budget) WHERE a.strategy = 'random' AND b.strategy = 'adaptive' GROUP BY b.entry""")
def paired_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = outcomes(spark, sf_dir).withColumnRenamed("strategy", "arm")
    met = metrics.paired_deltas(oc, "random", "adaptive", "evaluations", ["entry", "seed", "budget"])
    return met.groupBy("entry").agg(F.count("*").alias("pairs"), F.round(F.avg("delta"), 9).alias("delta"))


# ---- records ---------------------------------------------------------------------------------------------------------


@query("""SELECT k, CASE WHEN b.v IS NULL THEN 'only_a' WHEN a.v IS NULL THEN 'only_b' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status FROM (SELECT p_partkey AS k, p_brand || p_size AS v FROM part WHERE p_partkey % 7 <> 0) a
  FULL JOIN (SELECT p_partkey AS k, p_brand || CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0) b USING (k)""")
def archive_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    a = part.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.col("p_size").cast("string")).alias("value"))
    b = part.where("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("k"), F.concat("p_brand", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")).alias("value"))
    return compare.fields(a, b, ["k"]).select("k", "status")


@query("""WITH a AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size < 20), b AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WHERE p_size > 30)
  SELECT p_brand, a.p_partkey AS a, b.p_partkey AS b, CASE WHEN b.p_partkey IS NULL THEN 'only_a' WHEN a.p_partkey IS NULL THEN 'only_b' ELSE 'paired' END AS status FROM a FULL JOIN b USING (p_brand, n)""")
def findings_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return compare.paired(part.where("p_size < 20"), part.where("p_size > 30"), "p_brand", "p_partkey")


@query("SELECT CAST(doc_id AS VARCHAR) AS name FROM documents WHERE doc_id % 10 = 0")
def integrity_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose digest a manifest, wrong for every tenth, does not have."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), "doc_id")
    written = F.when(F.col("doc_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return compare.tampered(docs, docs.select("name", F.sha2(written.cast("binary"), 256).alias("sha256"))).select("name")


@query("SELECT event_id, k AS path, props::JSON ->> k AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.json_paths(read(spark, sf_dir, "events"), "props", ["event_id"])


@query("SELECT min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def no_duplicate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    return read(spark, sf_dir, "customer").select("c_custkey").intersect(orders.select("o_custkey")).subtract(orders.where("o_totalprice > 200000").select("o_custkey"))


@query("SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_max, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events")
def running_max_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select("event_id", F.round(F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("running_max"), F.round(F.col("value") - F.lag("value").over(w), 6).alias("change"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows, as the stream operators make them (additive: the reference has no streams)."""
    made = read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return made.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, nr""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after a gap of six hours."""
    made = read(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return made.select("user_id", F.col("w.start").alias("start"), "n")
