"""Calibration of magnitudes into strengths, and fusion of channels into one risk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.functions.median import medians
from plumbline.operators.evidence import CHANNELS
from plumbline.operators.lookup import looked_up
from plumbline.plans.scratch import stash

#: Least scales by channel: noise that is no evidence.
NOISE_FLOORS = {"Numerical": 1e-6, "Differential": 1e-9}
LEAST_SCALE = 1e-12
MIN_CLAIMS = 8
MAX_DISCOUNT = 0.95
PROVENANCE = 0.5
HIGH, MEDIUM = 0.75, 0.45


def _floor() -> Column:
    out = F.lit(LEAST_SCALE)
    for channel, least in NOISE_FLOORS.items():
        out = F.when(F.col("channel") == channel, F.lit(least)).otherwise(out)
    return out


def _counted(evidence: DataFrame) -> DataFrame:
    return evidence.where(~F.isnan("magnitude") & (F.col("magnitude") > 0) & (F.col("magnitude") < ieee.INF))


def channel_scale(evidence: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The median of each channel's positive finite magnitudes, at least its floor: keys, channel, scale."""
    return medians(_counted(evidence), [*keys, "channel"], "magnitude").select(*keys, "channel", F.greatest("median", _floor()).alias("scale"))


def claim_scale(evidence: DataFrame, keys: Sequence[str] = (), least: int = MIN_CLAIMS) -> DataFrame:
    """The same for each subject with at least so many magnitudes: keys, channel, subject, scale."""
    out = medians(_counted(evidence), [*keys, "channel", "subject"], "magnitude").where(F.col("n") >= least)
    return out.select(*keys, "channel", "subject", F.greatest("median", _floor()).alias("scale"))


def strength(magnitude: Column, scale: Column) -> Column:
    return F.when(ieee.gt(magnitude, scale), 1 - F.exp(-(ieee.div(magnitude, scale) - 1))).otherwise(F.lit(0.0))


def calibrated(evidence: DataFrame, by_channel: DataFrame, by_claim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """evidence with strengths from the claim's scale, else the channel's, else 1; fixed items keep theirs."""
    k = list(keys)
    channels, claims = stash(by_channel.withColumnRenamed("scale", "of_channel"), "scales"), stash(by_claim.withColumnRenamed("scale", "of_claim"), "scales")
    met = looked_up(looked_up(evidence, channels, [*k, "channel"], "left"), claims, [*k, "channel", "subject"], "left")
    own = strength(F.col("magnitude"), F.coalesce("of_claim", "of_channel", F.lit(1.0)))
    return met.withColumn("strength", F.when(F.col("fixed"), F.col("strength")).otherwise(own)).select(*evidence.columns)


def confidence(value: Column) -> Column:
    return F.when(value >= HIGH, "HIGH").when(value >= MEDIUM, "MEDIUM").otherwise("LOW")


def strongest(evidence: DataFrame, by: Sequence[str]) -> DataFrame:
    """The strongest item of each channel in each set: by, then one column a channel, 0 where it is silent."""
    return evidence.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("strength"))), F.lit(0.0)).alias(c) for c in CHANNELS])


def channel_correlation(sets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson's correlation of each two channels over the sets, within [0, 1]: keys, a, b, rho.

    Fewer than three sets, or a channel that never varies, give 0.
    """
    pairs = list(combinations(CHANNELS, 2))
    # Variances and covariances are mergeable sums: one aggregation, combined on the map side.
    sums = sets.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.var_pop(c) * F.count("*")).alias(f"v_{c}") for c in CHANNELS], *[(F.covar_pop(a, b) * F.count("*")).alias(f"c_{a}_{b}") for a, b in pairs])

    def rho(a: str, b: str) -> Column:
        spread = F.sqrt(F.col(f"v_{a}") * F.col(f"v_{b}"))
        r = F.try_divide(F.col(f"c_{a}_{b}"), spread)
        return F.when((F.col("n") >= 3) & (spread > 1e-300), F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))

    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), rho(a, b).alias("rho")) for a, b in pairs])
    return sums.select(*keys, F.inline(rows))


def overlap(mine: Column, theirs: Column) -> Column:
    """The discount for common observations: mine found in theirs, repeats counted, by the union."""
    shared = F.size(F.filter(mine, lambda m: F.array_contains(theirs, m)))
    jaccard = F.try_divide(shared.cast("double"), F.size(F.array_union(mine, theirs)).cast("double"))
    return F.when(shared == 0, F.lit(0.0)).when(jaccard >= 0.999, F.lit(MAX_DISCOUNT)).otherwise(PROVENANCE * jaccard)


def fused(evidence: DataFrame, by: Sequence[str], correlation: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The risk of each set: by, per_channel, score, dominant, contributions.

    Channels count from the strongest down. Each later one is discounted by the larger of its correlation with those
    before and the overlap of its observations with theirs.
    """
    by, keys = list(by), list(keys)
    each = evidence.groupBy(*by, "channel").agg(F.max("strength").alias("strength"), F.flatten(F.collect_list("observations")).alias("ids")).where("strength > 0")
    place = F.create_map(*[x for i, c in enumerate(CHANNELS) for x in (F.lit(c), F.lit(i))])
    each = each.withColumn("c", F.struct((-F.col("strength")).alias("order"), place[F.col("channel")].alias("place"), "channel", "strength", "ids"))
    sets = each.groupBy(*by).agg(F.sort_array(F.collect_list("c")).alias("ordered"))
    if correlation is None:
        sets = sets.withColumn("rho", F.array().cast("array<struct<a:string,b:string,rho:double>>"))
    else:
        rho = correlation.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "rho")).alias("rho"))
        sets = sets.join(rho, keys, "left") if keys else sets.crossJoin(F.broadcast(rho))  # ten pairs in one row
    start = F.struct(
        F.lit(1.0).alias("survival"), F.array().cast("array<string>").alias("channels"), F.array().cast("array<bigint>").alias("ids"),
        F.array().cast("array<struct<channel:string,strength:double,discount:double,accepted:double>>").alias("parts"),
    )

    def add(acc: Column, c: Column) -> Column:
        told = F.filter(F.col("rho"), lambda r: ((r["a"] == c["channel"]) & F.array_contains(acc["channels"], r["b"])) | ((r["b"] == c["channel"]) & F.array_contains(acc["channels"], r["a"])))
        known = F.coalesce(F.array_max(F.transform(told, lambda r: r["rho"])), F.lit(0.0))
        common = F.when(F.size(acc["channels"]) == 0, F.lit(0.0)).otherwise(F.coalesce(overlap(c["ids"], acc["ids"]), F.lit(0.0)))
        discount = F.least(F.greatest(known, common), F.lit(MAX_DISCOUNT))
        accepted = c["strength"] * (1 - discount)
        part = F.struct(c["channel"].alias("channel"), c["strength"].alias("strength"), discount.alias("discount"), accepted.alias("accepted"))
        return F.struct((acc["survival"] * (1 - accepted)).alias("survival"), F.concat(acc["channels"], F.array(c["channel"])).alias("channels"), F.concat(acc["ids"], c["ids"]).alias("ids"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    done = sets.withColumn("f", F.aggregate("ordered", start, add))
    per = F.array(*[F.coalesce(_of_channel(c), F.lit(0.0)) for c in CHANNELS])
    # The dominant channel is the one whose accepted part is largest, the last of equals.
    best = F.aggregate("f.parts", F.struct(F.lit(None).cast("string").alias("channel"), F.lit(-1.0).alias("accepted")), lambda a, p: F.when(p["accepted"] >= a["accepted"], F.struct(p["channel"].alias("channel"), p["accepted"].alias("accepted"))).otherwise(a))
    score = F.least(F.greatest(1 - F.col("f.survival"), F.lit(0.0)), F.lit(1.0))
    return done.select(*by, per.alias("per_channel"), score.alias("score"), best["channel"].alias("dominant"), F.col("f.parts").alias("contributions"))


def _of_channel(channel: str) -> Column:
    return F.get(F.transform(F.filter("f.parts", lambda p: p["channel"] == channel), lambda p: p["strength"]), F.lit(0))


def _undominated(table: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates: at least as large in all columns and larger in one."""
    order = np.lexsort(table.T[::-1])[::-1]  # a row comes after all that dominate it
    kept = np.empty((0, table.shape[1]))
    out = np.zeros(len(table), bool)
    for at in range(0, len(order), 256):
        rows = order[at : at + 256]
        block = table[rows]
        over = lambda by: ((by[None, :, :] >= block[:, None, :]).all(2) & (by[None, :, :] > block[:, None, :]).any(2)).any(1)
        fine = ~over(block)
        for k in range(0, len(kept), 4096):
            fine[fine] = ~(((kept[None, k : k + 4096] >= block[fine][:, None]).all(2) & (kept[None, k : k + 4096] > block[fine][:, None]).any(2)).any(1))
        out[rows[fine]] = True
        kept = np.concatenate([kept, block[fine]])
    return out


def pareto_front(rows: DataFrame, columns: Sequence[str], fan_in: int = 16) -> DataFrame:
    """Rows that no other row dominates: at least as large in all columns and larger in one. Rows with a null are in none.

    Equal rows do not dominate each other. Every task keeps the front of its own rows; fronts are merged a few tasks at a
    time, so no task holds more than the fronts of ``fan_in`` others, and no two rows meet that a task's front has dropped.
    """
    cols = list(columns)
    points = rows.select(*[F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(cols)]).dropna().distinct()
    schema = points.schema

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch]) if front is None else pa.concat_tables([front, pa.Table.from_batches([batch])])
            keep = _undominated(np.column_stack([c.to_numpy() for c in both.columns])) if both.num_rows else np.empty(0, bool)
            front = both.filter(pa.array(keep))
        if front is not None:
            yield from front.combine_chunks().to_batches()

    front = points.mapInArrow(local, schema)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        front = front.repartition(tasks).mapInArrow(local, schema)
    on = [F.col(c).cast("double") == F.col(f"_p{i}") for i, c in enumerate(cols)]
    return rows.join(front, on, "left_semi")


def own_evidence(evidence: DataFrame, keys: Sequence[str] = (), offenders: DataFrame | None = None) -> DataFrame:
    """Each item once for every observation it names: keys, id, and the item.

    offenders: rows (keys, subject, id) of items that name only some of theirs; they stand in for what the items name.
    """
    if offenders is None:
        return evidence.withColumn("id", F.explode(F.array_distinct("observations")))
    told = offenders.select(*keys, "subject").distinct()
    rest = evidence.join(told, [*keys, "subject"], "left_anti").withColumn("id", F.explode(F.array_distinct("observations")))
    return rest.unionByName(evidence.join(offenders, [*keys, "subject"]).select(*rest.columns))
