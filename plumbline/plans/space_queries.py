"""Driver queries about distances of doubles, trees of cells, and joins along a scale."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import distance, ieee
from plumbline.operators import asof, brackets, dyadic, intervals, lattice, scans
from plumbline.plans.queries import POINTS_SQL, ROOT, points, query, read
from plumbline.plans.scratch import shared_dir
from plumbline.streaming import chain

# ---- distances of doubles


@query("""
WITH paths AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS q, l_quantity * (1 - l_discount) AS a, CAST(CAST(l_quantity AS FLOAT) * (CAST(1 AS FLOAT) - CAST(l_discount AS FLOAT)) AS DOUBLE) AS b FROM lineitem),
power AS (
  SELECT *, CASE WHEN pow(2.0, floor(log2(a))) > a THEN floor(log2(a)) - 1 WHEN pow(2.0, floor(log2(a)) + 1) <= a THEN floor(log2(a)) + 1 ELSE floor(log2(a)) END AS ea,
            CASE WHEN pow(2.0, floor(log2(b))) > b THEN floor(log2(b)) - 1 WHEN pow(2.0, floor(log2(b)) + 1) <= b THEN floor(log2(b)) + 1 ELSE floor(log2(b)) END AS eb FROM paths)
SELECT l_orderkey, l_linenumber,
       abs((CAST(ea AS BIGINT) - CAST(eb AS BIGINT)) * 4503599627370496 + CAST((a / pow(2.0, ea) - 1) * 4503599627370496 AS BIGINT) - CAST((b / pow(2.0, eb) - 1) * 4503599627370496 AS BIGINT)) AS ulps,
       round(abs(a - b) / greatest(a, b) / 2.220446049250313e-16, 3) AS epsilons,
       round(CASE WHEN q - a = 0 THEN 0.0 ELSE greatest(log10(q / abs(q - a)), 0.0) END, 9) AS digits_lost
FROM power
""")
def path_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Double against single precision of every line: steps between their bits, noise units, and digits that q - y loses."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    single = (q.cast("float") * (F.lit(1.0).cast("float") - d.cast("float"))).cast("double")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), (q * (1 - d)).alias("a"), single.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("l_orderkey", "l_linenumber", distance.ulps(a, b).cast("long").alias("ulps"), F.round(distance.in_epsilons(a, b), 3).alias("epsilons"), F.round(ieee.cancellation(F.col("q"), a), 9).alias("digits_lost"))


# ---- the tree of cells

TREE = dyadic.Tree(ROOT[0], ROOT[1], 12)

TREE_SQL = "WITH RECURSIVE " + POINTS_SQL.lstrip() + """,
deep AS (SELECT *, CAST(greatest(ceil((q - 1.0) / (49.0 / 64)) - 1, 0) AS BIGINT) AS k0, CAST(greatest(ceil(d / (0.1::DOUBLE / 64)) - 1, 0) AS BIGINT) AS k1 FROM pts WHERE q >= 1 AND q <= 50 AND d >= 0 AND d <= 0.1),
sums AS (
  SELECT depth, k0 >> (6 - depth // 2) AS c0, k1 >> (6 - (depth + 1) // 2) AS c1, count(*) AS samples, sum(risk) AS risk_sum, max(risk) AS risk_max, bit_or(measured) AS measured,
         bool_or(risk >= 0.45 AND (fact OR bit_count(channels) >= 2)) AS strong
  FROM deep, (SELECT CAST(unnest(range(0, 13)) AS INT) AS depth) GROUP BY ALL),
labelled AS (
  SELECT *, CASE WHEN risk_max >= 0.7 OR risk_sum / samples >= 0.45 THEN CASE WHEN strong THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END WHEN samples < 4 OR bit_count(measured) < 1 THEN 'UNKNOWN' ELSE 'TRUSTED' END AS label FROM sums),
known AS (SELECT *, label = 'SUSPICIOUS' AS bad FROM labelled WHERE label <> 'UNKNOWN'),
meets AS (
  SELECT a.depth AS da, a.c0 AS a0, a.c1 AS a1, b.depth AS db, b.c0 AS b0, b.c1 AS b1 FROM known a JOIN known b ON a.bad <> b.bad
     AND (a.c0 + 1) << (6 - a.depth // 2) >= b.c0 << (6 - b.depth // 2) AND (b.c0 + 1) << (6 - b.depth // 2) >= a.c0 << (6 - a.depth // 2)
     AND (a.c1 + 1) << (6 - (a.depth + 1) // 2) >= b.c1 << (6 - (b.depth + 1) // 2) AND (b.c1 + 1) << (6 - (b.depth + 1) // 2) >= a.c1 << (6 - (a.depth + 1) // 2)),
tree AS (
  SELECT 0 AS pass, 0 AS depth, 0::BIGINT AS c0, 0::BIGINT AS c1
  UNION ALL
  SELECT pass + 1, CAST(depth + h AS INT), CASE WHEN h = 1 AND depth % 2 = 1 THEN c0 * 2 + side ELSE c0 END, CASE WHEN h = 1 AND depth % 2 = 0 THEN c1 * 2 + side ELSE c1 END
  FROM (SELECT t.*, CASE WHEN t.depth < 12 AND s.samples >= 4 AND (s.label = 'SUSPICIOUS' OR s.risk_sum / s.samples > 0.12
                 OR EXISTS (SELECT 1 FROM meets m JOIN tree o ON o.depth = m.db AND o.c0 = m.b0 AND o.c1 = m.b1 WHERE m.da = t.depth AND m.a0 = t.c0 AND m.a1 = t.c1)) THEN 1 ELSE 0 END AS h
        FROM tree t LEFT JOIN labelled s ON s.depth = t.depth AND s.c0 = t.c0 AND s.c1 = t.c1 WHERE t.pass < 12), (SELECT unnest([0, 1]) AS side)
  WHERE h = 1 OR side = 0),
leaves AS (SELECT t.depth, t.c0, t.c1, coalesce(s.samples, 0) AS samples, coalesce(s.risk_sum, 0.0) AS risk_sum, coalesce(s.label, 'UNKNOWN') AS label FROM tree t LEFT JOIN labelled s ON s.depth = t.depth AND s.c0 = t.c0 AND s.c1 = t.c1 WHERE pass = 12)"""


@query(TREE_SQL + " SELECT depth, c0, c1, samples, round(risk_sum, 6) AS risk_sum, label FROM leaves")
def dyadic_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves that refinement to depth 12 ends with."""
    return dyadic.refined(points(spark, sf_dir), TREE).select("depth", "c0", "c1", "samples", F.round("risk_sum", 6).alias("risk_sum"), "label")


@query(TREE_SQL + """ SELECT id, l.depth AS leaf_depth, label FROM pts p LEFT JOIN deep k USING (id, q, d) LEFT JOIN leaves l ON l.c0 = k.k0 >> (6 - l.depth // 2) AND l.c1 = k.k1 >> (6 - (l.depth + 1) // 2)""")
def dyadic_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf of every point, by prefixes of its key."""
    rows = points(spark, sf_dir)
    leaves = dyadic.refined(rows, TREE)
    met = dyadic.located(rows, leaves, TREE)
    labels = leaves.select(F.col("depth").alias("leaf_depth"), F.col("key").alias("leaf_key"), "label")
    return met.join(labels, ["leaf_depth", "leaf_key"], "left").select("id", "leaf_depth", "label")


BOX_SQL = "SELECT [min(l_quantity), min(l_extendedprice), min(l_discount)] AS lo, [max(l_quantity), max(l_extendedprice), max(l_discount)] AS hi FROM lineitem"


@query("WITH RECURSIVE box AS (" + BOX_SQL + """),
tree AS (
  SELECT 0 AS depth, 0::BIGINT AS key, lo, hi, lo AS rlo, hi AS rhi FROM box
  UNION ALL
  SELECT depth + 1, key * 2 + side, CASE WHEN side = 1 THEN [CASE WHEN i = axis THEN mid ELSE lo[i] END for i in [1, 2, 3]] ELSE lo END, CASE WHEN side = 0 THEN [CASE WHEN i = axis THEN mid ELSE hi[i] END for i in [1, 2, 3]] ELSE hi END, rlo, rhi
  FROM (SELECT *, (lo[axis] + hi[axis]) / 2 AS mid FROM (
    SELECT *, CASE WHEN s3 >= s2 AND s3 >= s1 THEN 3 WHEN s2 >= s1 THEN 2 ELSE 1 END AS axis FROM (
      SELECT *, (hi[1] - lo[1]) / (rhi[1] - rlo[1]) AS s1, (hi[2] - lo[2]) / (rhi[2] - rlo[2]) AS s2, (hi[3] - lo[3]) / (rhi[3] - rlo[3]) AS s3 FROM tree WHERE depth < 11))), (SELECT unnest([0, 1]) AS side)
  WHERE mid > lo[axis] AND mid < hi[axis])
SELECT depth, key, round(lo[1], 9) AS lo0, round(lo[2], 6) AS lo1, round(lo[3] + 0.0, 9) AS lo2, round(hi[1], 9) AS hi0, round(hi[2], 6) AS hi1, round(hi[3], 9) AS hi2 FROM tree
""")
def permitted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell down to depth 11 of the box that lineitem fills, by a recursive query."""
    lines = read(spark, sf_dir, "lineitem")
    ends = lambda f: F.array(*[f(c) for c in ("l_quantity", "l_extendedprice", "l_discount")])
    box = lines.agg(ends(F.min).alias("lo"), ends(F.max).alias("hi"))
    digits = (9, 6, 9)
    return dyadic.permitted(box, 11).select("depth", "key", *[F.round(F.get(side, F.lit(i)) + 0.0, n).alias(f"{side}{i}") for side in ("lo", "hi") for i, n in enumerate(digits)])


@query("SELECT depth, CAST(1 << depth AS BIGINT) AS cells, CAST(1 << depth AS DOUBLE) / (1 << depth) AS volume FROM (SELECT CAST(unnest(range(0, 13)) AS INT) AS depth) WHERE (SELECT count(*) FROM lineitem) > 0")
def permitted_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each depth of lineitem's box may have, and that they fill it."""
    lines = read(spark, sf_dir, "lineitem")
    box = lines.agg(F.array(F.min("l_quantity"), F.min("l_extendedprice")).alias("lo"), F.array(F.max("l_quantity"), F.max("l_extendedprice")).alias("hi"))
    cells = dyadic.permitted(box, 12)
    size = F.aggregate(F.zip_with("hi", "lo", lambda h, low: h - low), F.lit(1.0), lambda a, v: a * v)
    by = cells.groupBy("depth").agg(F.count(F.lit(1)).alias("cells"), F.sum(size).alias("size"))
    root = F.first("size").over(Window.orderBy("depth"))  # a row a depth
    return by.select("depth", "cells", F.round(F.col("size") / root, 9).alias("volume"))


# ---- along a scale


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t FROM events),
r AS (SELECT user_id, t, max(event_id) AS event_id FROM e WHERE event_type = 'purchase' GROUP BY user_id, t)
SELECT l.event_id, r.event_id AS purchase_id, l.t - r.t AS gap_us FROM (SELECT * FROM e WHERE event_type = 'error') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t
""")
def asof_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of the same user before each error."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    side = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    met = asof.join(side("error"), side("purchase"), "t", by=["user_id"], tie=["event_id"])
    return met.select("event_id", F.col("match.event_id").alias("purchase_id"), asof.gap("match", "t").alias("gap_us"))


@query("""
WITH o AS (SELECT o_orderkey, epoch_us(o_orderdate) AS t FROM orders),
r AS (SELECT epoch_us(l_shipdate) AS t, arg_max(l_orderkey, l_orderkey * 64 + l_linenumber) AS l_orderkey, arg_max(l_linenumber, l_orderkey * 64 + l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1),
b AS (SELECT o.o_orderkey, o.t, r.t AS rt, r.l_orderkey, r.l_linenumber FROM o ASOF LEFT JOIN r ON o.t >= r.t),
a AS (SELECT o.o_orderkey, r.t AS rt, r.l_orderkey, r.l_linenumber FROM o ASOF LEFT JOIN r ON o.t < r.t)
SELECT o_orderkey, CASE WHEN back THEN b.l_orderkey ELSE a.l_orderkey END AS l_orderkey, CASE WHEN back THEN b.l_linenumber ELSE a.l_linenumber END AS l_linenumber, CASE WHEN back THEN b.t - b.rt ELSE a.rt - b.t END AS gap_us
FROM (SELECT b.*, a.rt AS art, b.rt IS NOT NULL AND (a.rt IS NULL OR b.t - b.rt <= a.rt - b.t) AS back FROM b JOIN a USING (o_orderkey)) b JOIN a USING (o_orderkey)
""")
def nearest_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line shipped nearest to each order's date; of equally near the earlier, of one date the largest line."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("t")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", us("o_orderdate"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", us("l_shipdate"))
    met = asof.join(orders, lines, "t", tie=["l_orderkey", "l_linenumber"], direction=asof.NEAREST)
    return met.select("o_orderkey", "match.l_orderkey", "match.l_linenumber", asof.gap("match", "t").alias("gap_us"))


SESSIONS_SQL = """
e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM e),
sessions AS (SELECT user_id, min(t) AS lo, max(t) AS hi, count(*) AS n FROM n GROUP BY user_id, nr)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's sessions, which end after a gap of an hour, from their first to their last event."""
    rows = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    us = lambda f: F.unix_micros(f("ts"))
    return rows.groupBy(F.session_window("ts", "1 hour").alias("w"), "user_id").agg(us(F.min).alias("lo"), us(F.max).alias("hi"), F.count("*").alias("n")).drop("w")


@query("WITH " + SESSIONS_SQL + """
SELECT a.user_id, a.lo, count(*) AS others, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS shared_us
FROM sessions a JOIN sessions b ON a.lo <= b.hi AND b.lo <= a.hi AND a.user_id <> b.user_id GROUP BY a.user_id, a.lo""")
def session_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions of other users each session overlaps, and for how long in all."""
    rows = sessions(spark, sf_dir).where("user_id is not null")
    # A user's sessions are apart, so of those that a session overlaps only it itself is its user's.
    length = F.col("hi") - F.col("lo")
    totals = intervals.overlap_totals(rows, ["user_id", "lo", "hi"]).select("user_id", "lo", (F.col("met") - 1).alias("others"), (F.col("shared") - length).alias("shared_us"))
    return totals.where("others > 0")


@query("WITH " + SESSIONS_SQL + """
SELECT e.event_id, count(*) AS live FROM events e JOIN sessions s ON epoch_us(e.ts) BETWEEN s.lo AND s.hi AND s.n > 1 WHERE e.event_type = 'error' GROUP BY e.event_id""")
def errors_in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many sessions of several events each error falls."""
    errors = read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    rows = sessions(spark, sf_dir).where("n > 1")
    base, levels = intervals.levels_for((errors, "t"), (rows, "lo"), (rows, "hi"))
    return intervals.stabbing(errors, rows, "t", "lo", "hi", base=base, levels=levels).groupBy("point.event_id").agg(F.count("*").alias("live"))


# ---- level sets


@query("""
WITH p AS (
  SELECT l_shipdate AS d, l_orderkey * 64 + l_linenumber AS id, l_returnflag || l_linestatus AS cell, (l_extendedprice - 900) / 104100 AS u0, l_discount / 0.1 AS u1,
         (80000 - l_extendedprice * (1 - l_discount)) / greatest(l_extendedprice * (1 - l_discount), 80000) AS level FROM lineitem),
one AS (SELECT cell, level < 0 AS side, u0, u1, min(id) AS id FROM p GROUP BY ALL),
ends AS (SELECT cell, side, u1, min(u0) AS a, max(u0) AS b FROM one GROUP BY ALL),
few AS (SELECT one.* FROM one JOIN ends e ON one.cell = e.cell AND one.side = e.side AND one.u1 = e.u1 AND (u0 = e.a OR u0 = e.b)),
pairs AS (SELECT a.cell, a.id AS failing, b.id AS holding, (a.u0 - b.u0) * (a.u0 - b.u0) + (a.u1 - b.u1) * (a.u1 - b.u1) AS gap2 FROM few a JOIN few b ON a.cell = b.cell AND a.side AND NOT b.side)
SELECT cell, failing, holding, round(gap2, 9) AS gap2 FROM pairs QUALIFY row_number() OVER (PARTITION BY cell ORDER BY gap2 DESC, failing, holding) = 1
""")
def widest_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest bracket of net price 80,000 in (price, discount), for each flag and status of lineitem."""
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    net = price * (1 - discount)
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cell"), (F.col("l_orderkey") * 64 + F.col("l_linenumber")).alias("id"), F.array((price - 900) / 104100, discount / 0.1).alias("u"), ((80000 - net) / F.greatest(net, F.lit(80000.0))).alias("level"))
    return brackets.widest(rows).select("cell", "failing", "holding", F.round("gap2", 9).alias("gap2"))


# ---- credits of families, as event types


@query("""
WITH RECURSIVE e AS (
  SELECT event_id, event_type, greatest(value, 0.0) AS gain, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, row_number() OVER (ORDER BY ts, event_id) AS total FROM events),
v AS (
  SELECT event_id, event_type, n, total, 0.1 * gain AS value FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.event_type, e.n, e.total, 0.9::DOUBLE * v.value + 0.1::DOUBLE * e.gain FROM v JOIN e ON e.event_type = v.event_type AND e.n = v.n + 1)
SELECT event_id, n, total, round(value, 9) AS value, round(value + sqrt(2.0 * ln(total + 1) / n) * 0.05, 9) AS bound FROM v
""")
def family_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each event: the fading mean of its type's values, how often the type and any type came, and the upper bound."""
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    order = ["t", "event_id"]
    counted = scans.numbered(scans.numbered(rows, ["event_type"], order, "n"), [], order, "total")
    made = scans.fading(counted.withColumnRenamed("value", "gain"), ["event_type"], order, "gain", 0.1)
    bound = F.col("value") + F.sqrt(2.0 * F.log(F.col("total") + 1.0) / F.col("n")) * 0.05
    return made.select("event_id", "n", "total", F.round("value", 9).alias("value"), F.round(bound, 9).alias("bound"))


# ---- lattices

SIZES = (50, 11, 9)


@query("""
WITH p AS (SELECT CAST(round(l_quantity - 1) AS BIGINT) AS a, CAST(round(l_discount / 0.01) AS BIGINT) AS b, CAST(round(l_tax / 0.01) AS BIGINT) AS c, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total FROM lineitem),
s AS (SELECT a + 50 * b + 550 * c AS key, a, b, c, count(*) AS n, avg(total) > 52000 AS violated, a >= 20 AND b <= 5 AS inside FROM p WHERE a BETWEEN 0 AND 49 AND b BETWEEN 0 AND 10 AND c BETWEEN 0 AND 8 GROUP BY ALL)
SELECT key, n, CASE WHEN inside THEN CASE WHEN violated THEN 'agrees' ELSE 'empty' END WHEN NOT violated THEN 'agrees'
  WHEN EXISTS (SELECT 1 FROM s o WHERE o.inside AND o.key <> s.key AND abs(o.a - s.a) <= 1 AND abs(o.b - s.b) <= 1 AND abs(o.c - s.c) <= 1) THEN 'boundary' ELSE 'stray' END AS verdict FROM s
""")
def lattice_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem's lattice of quantity, discount and tax: which sites agree with a declared region, and which violate beside it."""
    x = F.array("l_quantity", "l_discount", "l_tax")
    total = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = read(spark, sf_dir, "lineitem").select(x.alias("x"), total.alias("total"))
    on = lattice.placed(rows, (1.0, 0.0, 0.0), (1.0, 0.01, 0.01), SIZES)
    sites = on.groupBy("key").agg(F.count("*").alias("n"), (F.avg("total") > 52000).alias("violated"))
    sites = sites.withColumn("inside", (F.col("key") % 50 >= 20) & (F.floor(F.col("key") / 50) % 11 <= 5))
    return lattice.layered(sites, SIZES).select("key", "n", "verdict")


# ---- journals


@query("""
WITH RECURSIVE lines AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr, event_id || '|' || event_type || '|' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS line FROM events),
chain AS (
  SELECT user_id, nr, sha256(repeat('0', 64) || chr(10) || line) AS digest FROM lines WHERE nr = 1
  UNION ALL
  SELECT l.user_id, l.nr, sha256(c.digest || chr(10) || l.line) FROM chain c JOIN lines l ON l.user_id = c.user_id AND l.nr = c.nr + 1)
SELECT CAST(user_id AS VARCHAR) AS journal, nr, digest, 'linked' AS status FROM chain
""")
def line_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a journal whose lines come as a stream, three files in no order, chained by digest."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    lines = scans.numbered(rows, ["user_id"], ["t", "event_id"], "nr")
    text = F.concat_ws("|", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").cast("string"))
    given = lines.select(F.col("user_id").cast("string").alias("journal"), "nr", "at", text.alias("line"))
    folder = f"{shared_dir(spark)}/chains-{uuid.uuid4().hex}"
    given.repartition(3, F.xxhash64("nr", "journal")).write.parquet(f"{folder}/lines")
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines")
    with chain.provider(spark):
        made = chain.chained(stream, datetime.timedelta(days=3650), datetime.timedelta(days=3650), late="3650 days")
        made.writeStream.format("parquet").option("path", f"{folder}/chain").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/chain")
