"""Rows joined with a table of one row a key, without a task that gets all rows of a frequent key.

A table of few keys goes to the tasks whole, and the rows stay where they are. Of a larger one only the keys that most rows
have do; no other key has more than one in ``FEW`` of the rows, and those are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: So many of a table's rows go to every task.
FEW = 10_000


def looked_up(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False) -> DataFrame:
    """rows with the other columns of table, whose keys are unique; how: inner or left. null_safe: a null key meets a null.

    table is read more than once, so it should be cheap to read.
    """
    keys = list(keys)
    named = [f"_t{i}" for i in range(len(keys))]
    small = table.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], *[c for c in table.columns if c not in keys])

    def same(names: Sequence[str], safe: bool) -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) if safe else F.col(k) == F.col(n) for k, n in zip(keys, names, strict=True)], F.lit(True))

    if table.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(small), same(named, null_safe), how).drop(*named)
    hot_names = [f"_h{i}" for i in range(len(keys))]
    often = rows.groupBy(*keys).count().orderBy(F.desc("count")).limit(FEW)
    hot = F.broadcast(often.select(*[F.col(k).alias(n) for k, n in zip(keys, hot_names, strict=True)]))
    told = small.join(hot, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(h)) for n, h in zip(named, hot_names, strict=True)]), "left_semi")
    first = rows.join(hot, same(hot_names, True), "left_semi").join(F.broadcast(told), same(named, null_safe), how)
    rest = rows.join(hot, same(hot_names, True), "left_anti").join(small, same(named, null_safe), how)
    return first.unionByName(rest).drop(*named)
