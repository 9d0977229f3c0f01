"""Exact medians of groups of any size, without a group's values in one task.

Spark's own median holds every distinct value of a group in one buffer. Here a mergeable sketch brackets the middle of
each group; values below the bracket are only counted, and only the bracket's rows, about a thousandth, are put in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.lookup import looked_up
from plumbline.plans.scratch import stash

#: Half the bracket's width in ranks, as a share of the group; five times the sketch's error.
HALF = 5e-4
ACCURACY = 10_000


def medians(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, median and n of each group's non-null values: the middle one, or the mean of the middle two."""
    keys = list(keys)
    known = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", [0.5 - HALF, 0.5 + HALF], ACCURACY).alias("_b"))
    sketch = sketch.where("n > 0").select(*keys, "n", F.get("_b", F.lit(0)).alias("_lo"), F.get("_b", F.lit(1)).alias("_hi"))
    met = looked_up(known, stash(sketch, "sketch"), keys, null_safe=True).where(F.col("_v") <= F.col("_hi"))
    # One row for all values below the bracket, and one for equal values in it: the rows of a group are counted where they are.
    under = F.col("_v") < F.col("_lo")
    counted = met.groupBy(*keys, "n", under.alias("_under"), F.when(~under, F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.desc("_under"), "_v")
    upto = counted.withColumn("_past", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("_past") - F.col("_c")
    holds = lambda rank: F.max(F.when((first <= rank) & (rank < F.col("_past")), F.col("_v")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return upto.groupBy(*keys, "n").agg(((holds(low) + holds(high)) / 2).alias("median")).select(*keys, "median", "n")
