"""Running values along an order, without a task that holds a whole key: numbers, and fading means.

Rows are dealt by ranges of (keys, order). Within a range what comes before is summed up in place; what a range does to a
running value is one row (a count, or an affine map v -> a v + b), and these rows, one for each range and key that meet,
are put together along the order and handed on to the rows behind. Affine maps put together are affine maps, so an
exponentially fading mean of a hot key is as parallel as a sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.ranges import default_ranges, range_of, splitters
from plumbline.plans.scratch import stash


def dealt(rows: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows with _part, the range of their keys; keys are numbers or strings without nulls."""
    return rows.withColumn("_part", range_of(rows, keys, splitters(rows, keys, ranges or default_ranges(rows))))


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{i}") for i, k in enumerate(keys)], F.col("_part") == F.col("_p"))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str, ranges: int | None = None) -> DataFrame:
    """rows with the number, from 1, of each within its keys along an order that has no ties."""
    by = list(by)
    parts = stash(dealt(rows, [*by, *order], ranges), "scan")
    own = parts.withColumn(name, F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order)).cast("long"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{i}") for i, k in enumerate(by)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return own.join(bases, _same(by)).select(*rows.columns, (F.col(name) + F.col("_base")).alias(name))


def fading(rows: DataFrame, by: Sequence[str], order: Sequence[str], gain: str, alpha: float, name: str = "value", ranges: int | None = None) -> DataFrame:
    """rows with the fading mean of their keys after them: v = (1 - alpha) v + alpha max(gain, 0), from 0 on.

    A null or NaN gain counts as 0. keys and order have no nulls, the order no ties.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is above 0 and at most 1")
    by, keep = list(by), 1.0 - alpha
    parts = dealt(rows, [*by, *order], ranges)
    laid = parts.repartition("_part").sortWithinPartitions("_part", *by, *order)
    spec = rows.withColumns({"_part": F.lit(0), "_a": F.lit(0.0), "_b": F.lit(0.0)}).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a, b = None, 1.0, 0.0
        for f in frames:
            gains = np.fmax(np.nan_to_num(f[gain].to_numpy(float), nan=0.0), 0.0) * alpha
            whose = list(zip(f["_part"], *[f[k] for k in by], strict=True))
            out = np.empty((2, len(f)))
            for i, (who, g) in enumerate(zip(whose, gains.tolist(), strict=True)):
                if who != at:
                    at, a, b = who, 1.0, 0.0
                a, b = a * keep, b * keep + g
                out[0, i], out[1, i] = a, b
            yield f.assign(_a=out[0], _b=out[1])

    maps = stash(laid.mapInPandas(run, spec), "fading")
    # The last row of a range and key holds what the range does: one map each, put together along the order.
    ends = maps.groupBy("_part", *by).agg(F.max_by(F.struct("_a", "_b"), F.struct(*order)).alias("m"))
    chain = ends.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_part", "m"))).alias("ms"))  # a key's ranges

    def compose(acc: Column, m: Column) -> Column:
        here = F.struct(m["_part"].alias("_p"), acc["v"].alias("_v"))
        return F.struct((acc["v"] * m["m"]["_a"] + m["m"]["_b"]).alias("v"), F.concat(acc["told"], F.array(here)).alias("told"))

    start = F.struct(F.lit(0.0).alias("v"), F.array().cast("array<struct<_p:int,_v:double>>").alias("told"))
    told = chain.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(by)], F.inline(F.aggregate("ms", start, compose)["told"]))
    return maps.join(told, _same(by)).select(*rows.columns, (F.col("_a") * F.col("_v") + F.col("_b")).alias(name))
