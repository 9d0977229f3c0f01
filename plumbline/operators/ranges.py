"""Rows dealt by ranges of a key, so that what runs along an order is one external sort a range, and not one task.

Splitters are quantiles of a bounded sample; each row finds its range by binary search among them. Which splitters there
are decides where work is done, never what comes out.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges for each shuffle partition, sampled keys for each range, and sampled keys at most.
RANGES = 4
SAMPLE = 10
SAMPLE_MOST = 1_000_000


def default_ranges(rows: DataFrame) -> int:
    return RANGES * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def splitters(rows: DataFrame, keys: Sequence[str], ranges: int) -> list[tuple]:
    """At most ranges - 1 keys that part the rows about evenly; keys are numbers or strings without nulls."""
    n = rows.count()
    if not n or ranges < 2:
        return []
    share = min(1.0, min(SAMPLE * ranges, SAMPLE_MOST) / n)
    some = rows.select(*keys).sample(fraction=share, seed=11) if share < 1 else rows.select(*keys)
    found = sorted(tuple(r) for r in some.toLocalIterator())
    return [found[i * len(found) // ranges] for i in range(1, ranges)] if found else []


def range_of(rows: DataFrame, keys: Sequence[str], cuts: list[tuple]) -> Column:
    """How many splitters are not above the row's key."""
    if not cuts:
        return F.lit(0)
    kind = ", ".join(f"k{i}: {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    held = F.from_json(F.lit(json.dumps([{f"k{i}": v for i, v in enumerate(c)} for c in cuts])), f"array<struct<{kind}>>")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    steps = [F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= key, low + step).otherwise(low))
