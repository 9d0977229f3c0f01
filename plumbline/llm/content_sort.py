"""Exact dedup by sorting content: equal texts meet as neighbours of one external sort.

Texts are equal when they are identical after every run of ``[\\x20\\x09-\\x0D]`` has become one space. Rows are ordered by
their normalised bytes: by their first characters, then by digest (so that a splitter is of bounded size however long its
text is), then by the whole text, then by id. Splitters are quantiles of a bounded sample of these keys; each row finds its
range by binary search among them, each range is one external sort, and in it every row's whole text is compared with its
neighbour's. As ids are part of the keys, a text that a third of all rows share fills as many ranges as its rows need.
The first and the last text of each range are compared with those of the ranges next to it, and runs that go on there are
counted as one. Of each run of equal texts the row with the smallest id stays.

Edge cases: a null text counts as an empty one; a text of white space alone is one space, which is not the empty text; a
row without id sorts after all ids, so it stays only where no equal text has an id; of rows with equal text and equal
smallest id exactly one stays; no rows give no rows; columns besides doc_id and text may have any name and pass through
``dedup_exact`` as they are.

Scale: texts are shuffled once. The driver holds the sampled keys (``SAMPLE`` a range, a million at most, some 100 bytes
each); the plan holds the splitters, one a range. What is broadcast is one row of numbers for each run at the edge of a
range, two a range at most. Samples choose where ranges begin, never which rows are equal: the result is the same for
any splitters.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import WHITE, buckets_of, stash

#: Ranges for each shuffle partition, sampled keys for each range, and sampled keys at most.
RANGES = 4
SAMPLE = 10
SAMPLE_MOST = 1_000_000
#: Characters of a text that a splitter holds.
HEAD = 24

_LAST_ID = 2**63 - 1
_KEY = "struct<head:string,sha:string,id:long>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE}+", " ")


def keyed(docs: DataFrame, carry: bool) -> DataFrame:
    """(doc_id, norm, key, row): each row's normalised text, its place in the order, and where asked all its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.lit(None).cast("string")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"), row.alias("row"))
    key = F.struct(F.substring("norm", 1, HEAD).alias("head"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"), F.coalesce("doc_id", F.lit(_LAST_ID)).alias("id"))
    return known.select("doc_id", "norm", key.alias("key"), "row")


def splitters(docs: DataFrame, ranges: int, sample: int = SAMPLE) -> list[tuple[str, str, int]]:
    """At most ranges - 1 keys that part the rows about evenly, from a sample of sample * ranges keys on average."""
    n = docs.count()
    if not n or ranges < 2:
        return []
    share = min(1.0, min(sample * ranges, SAMPLE_MOST) / n)
    some = docs.sample(fraction=share, seed=11) if share < 1 else docs
    keys = sorted(tuple(r) for r in keyed(some, False).select("key.*").toLocalIterator())  # by code points, as UTF-8 sorts
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []


def range_of(key: Column, cuts: list[tuple[str, str, int]]) -> Column:
    """How many splitters are not above the key, by binary search."""
    if not cuts:
        return F.lit(0)
    held = F.from_json(F.lit(json.dumps([dict(zip(("head", "sha", "id"), c, strict=True)) for c in cuts])), f"array<{_KEY}>")
    steps = [F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda low, step: F.when(F.get(held, low + step - 1) <= key, low + step).otherwise(low))


def runs(docs: DataFrame, ranges: int | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, sha, part, run, starts, first, last, edge, n, keep, row): rows in runs of equal neighbours of their range.

    first and last mark the rows at a range's ends, whose texts are in edge; n and keep are the run's rows and smallest id.
    """
    ranges = ranges or RANGES * buckets_of(docs.sparkSession)
    rows = keyed(docs, carry).withColumn("part", range_of(F.col("key"), splitters(docs, ranges)))
    order = Window.partitionBy("part").orderBy("key.head", "key.sha", "norm", F.col("doc_id").asc_nulls_last())
    near = rows.select("*", F.lag("norm").over(order).alias("before"), F.lead(F.lit(1)).over(order).isNull().alias("last"), F.row_number().over(order).alias("place"))
    first, starts = F.col("before").isNull(), F.col("before").isNull() | (F.col("before") != F.col("norm"))
    near = near.select("doc_id", F.col("key.sha").alias("sha"), "part", "place", starts.alias("starts"), first.alias("first"), "last", F.when(first | F.col("last"), F.col("norm")).alias("edge"), F.when(starts, F.col("row")).alias("row"))
    number = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy("part", "run")
    return near.withColumn("run", number).select("*", F.count(F.lit(1)).over(whole).alias("n"), F.min("doc_id").over(whole).alias("keep")).drop("place")


def edge_runs(rows: DataFrame) -> DataFrame:
    """(part, run, total, smallest, opens) of each run at an end of its range, with those of the runs that it goes on from.

    Ranges are numbered without gaps first, so that each meets the one before it by an equi-join and whole texts are compared.
    What is summed up in one order has two rows of numbers a range at most.
    """
    ends = rows.where("first or last")
    parts = ends.select("part").distinct().select("part", F.row_number().over(Window.orderBy("part")).alias("at"))
    ends = ends.join(parts, "part")
    begins = ends.where("first").select("part", "at", F.col("edge").alias("mine"))
    closes = ends.where("last").select((F.col("at") + 1).alias("at"), F.col("edge").alias("theirs"))
    goes_on = begins.join(closes, "at").where("mine = theirs").select("part", F.lit(True).alias("goes_on"))
    heads = ends.groupBy("part", "run").agg(F.max("first").alias("opening"), F.max("n").alias("n"), F.min("keep").alias("keep"))
    linked = heads.join(goes_on, "part", "left").select("part", "run", "n", "keep", (F.col("opening") & F.col("goes_on").isNotNull()).alias("linked"))
    order = Window.orderBy("part", "run")
    chains = linked.withColumn("chain", F.sum((~F.col("linked")).cast("long")).over(order))
    chain = Window.partitionBy("chain")
    return chains.select("part", "run", F.sum("n").over(chain).alias("total"), F.min("keep").over(chain).alias("smallest"), (~F.col("linked")).alias("opens"))


def groups(docs: DataFrame, ranges: int | None = None, carry: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row) of every row of docs; row is its columns, where kept and asked."""
    rows, _ = stash(runs(docs, ranges, carry), "content-runs")
    met = rows.join(F.broadcast(edge_runs(rows)), ["part", "run"], "left")
    inner = F.col("total").isNull()
    return met.select(
        "doc_id",
        F.when(inner, F.col("keep")).otherwise(F.col("smallest")).alias("keep_id"),
        F.when(inner, F.col("n")).otherwise(F.col("total")).alias("group_size"),
        (F.col("starts") & (inner | F.col("opens"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "row",
    )


def dedup_exact(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return groups(docs, ranges, carry=True).where("kept").select("row.*")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return groups(docs).drop("row")


REPORT_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents)
"""
