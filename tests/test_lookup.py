"""Joins and medians of groups that most rows belong to."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.functions.median import medians
from plumbline.operators import calibrate, evidence, lookup


@pytest.mark.parametrize("few", [2, 10_000])
@pytest.mark.parametrize("null_safe", [False, True])
def test_looked_up(spark, monkeypatch, few, null_safe):
    monkeypatch.setattr(lookup, "FEW", few)
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["hot"] * 6 + ["b", "c", "d", None]), rnd.choice([1, 2, None])) for i in range(300)]
    table = [(k, n, f"{k}{n}") for k in ["hot", "b", "c", None] for n in [1, 2, None]]
    df, small = spark.createDataFrame(rows, "i long, k string, n int"), spark.createDataFrame(table, "k string, n int, v string")
    value = {(k, n): v for k, n, v in table if null_safe or (k is not None and n is not None)}
    left = sorted((r.i, r.v) for r in lookup.looked_up(df, small, ["k", "n"], "left", null_safe).collect())
    assert left == [(i, value.get((k, n))) for i, k, n in rows]
    inner = sorted((r.i, r.v) for r in lookup.looked_up(df, small, ["k", "n"], null_safe=null_safe).collect())
    assert inner == [x for x in left if x[1] is not None]


@pytest.mark.parametrize("few", [2, 10_000])
def test_medians_of_hot_groups(spark, monkeypatch, few):
    monkeypatch.setattr(lookup, "FEW", few)
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 8 + ["b", "c", None]), rnd.choice([None, 1.0, float("-inf"), rnd.random(), rnd.random()])) for _ in range(3000)] + [("one", 7.0), ("none", None)]
    got = {r.k: (r.median, r.n) for r in medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    mine = {k: [v for c, v in rows if c == k and v is not None] for k, _ in rows}
    assert got == {k: (statistics.median(v), len(v)) for k, v in mine.items() if v}


def test_rows_of_few_claims_stay_where_they_are(spark):
    rows = spark.range(5000).select(F.lit("Numerical").alias("channel"), F.lit("s").alias("subject"), (F.col("id") + 1.0).alias("magnitude"), F.lit(0.0).alias("strength"), F.array("id").alias("observations"), F.lit(False).alias("fixed"))
    made = calibrate.calibrated(rows, calibrate.channel_scale(rows), calibrate.claim_scale(rows))
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.agg(F.max("strength")).first()[0] == pytest.approx(1 - 2.718281828459045 ** -(5000 / 2500.5 - 1))
    values = spark.range(400).select(F.col("id").alias("base"), (F.col("id") + 1).alias("perturbed"), F.lit(0).alias("axis"), F.lit(0).alias("output"), F.lit(0.0).alias("x0"), F.lit(1.0).alias("x1"), F.lit(0.0).alias("y0"), (F.col("id") + 1.0).alias("y1"))
    steep = evidence.sensitivity(values)
    assert steep.count() == 100 and "Exchange hashpartitioning" not in steep._jdf.queryExecution().executedPlan().toString()
