"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents, shuffled by a hash of their id, queue up to ``max_epochs`` times over. A document's virtual
finish time is the words its source has sent when it is through, divided by the source's weight. All documents are
taken in the order of their finish times (ties: source, shuffle key, id, size) until the budget, all sources' words by
default, would be passed. A source that runs dry stops there and the others share what it leaves, so what each source
gives follows its target: weight times the common level of virtual time, max_epochs times its own size at most.

Edge cases: a null text has no words and is never repeated; a null source is one source, the last; null ids share one
shuffle key; rows with an equal id lie side by side and each counts; no rows or no words give target 0 and taken 0;
extra columns pass through ``mix``, which renames its own columns where they clash.

Scale: no source is gathered in one task. Running sums within a source go over bins of the shuffle key, and the cut
through the global order over bins of the finish time; both have about sqrt(n) bins of sqrt(n) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import clear_of, fine_bins, running_sums, stash, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For (source, source_size): the source's weight, its target words and the level of virtual time it is reached at.

    Sources by code point, null last, weigh weights in turn. Targets share the sum of all sizes by weight; one that
    would pass max_epochs times its source's size stops there, and the others share the rest.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("most", (F.col("source_size") * max_epochs).cast("double")).withColumn("dry", F.col("most") / F.col("weight"))
    # Sources in the order in which they run dry: the level is found where those before have run dry and the rest have not.
    up = Window.orderBy("dry", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("dry", "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = weighed.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") <= F.col("dry"), F.struct("dry", "rank", "level"))).over(whole)["level"]
    return levels.withColumn("common", F.coalesce(level, F.lit(0.0))).select("source", "source_size", "rank", "weight", F.least("most", F.col("weight") * F.col("common")).alias("target"), "common")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For each document: doc_id, source, size, source_size, weight, target, key, sent, first_finish and copies.

    first_finish is the finish time of the first copy; each further one comes source_size / weight later.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sized, _ = stash(sized, "mixing-sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_source, _ = stash(by_source, "mixing-sources")
    shares = targets(by_source.select("source", "source_size"), weights, max_epochs)
    shares, _ = stash(shares, "mixing-shares")
    n, budget, level = by_source.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).crossJoin(shares.agg(F.max("common"))).first()
    bins = fine_bins(n)
    binned = sized.withColumn("bin", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * bins / F.lit(1 << 32)).cast("long"))
    summed = running_sums(binned, ["source"], "bin", ["key", "doc_id", "size"], {"sent": F.col("size")}).drop("bin")
    s = shares.select(F.col("source").alias("_source"), "source_size", "rank", "weight", "target")
    queued = summed.join(s, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("first_finish", F.col("sent") / F.col("weight"))
    queued, _ = stash(queued, "mixing-queue")

    # The cut: bins of finish times are summed up, and only the bin in which the budget ends is put in order.
    epochs = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    copies = queued.where("size > 0").select("rank", "key", "doc_id", "size", "sent", "source_size", "weight", epochs.alias("epoch"))
    copies = copies.withColumn("finish", finish(F.col("epoch"))).withColumn("bin", F.least(F.floor(F.col("finish") / F.lit(level or 1.0) * bins), F.lit(bins * 4)))
    before = copies.groupBy("bin").agg(F.sum("size").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = before.where(F.col("before") + F.col("here") > budget).orderBy("bin").first()
    if edge is None:
        cut = copies.agg(F.max(order())).first()[0]
    else:
        at = copies.where(F.col("bin") == edge["bin"]).withColumn("sum", F.sum("size").over(Window.orderBy(order()).rowsBetween(Window.unboundedPreceding, 0)))
        over = at.where(F.col("sum") + edge["before"] > budget).agg(F.min(order())).first()[0]  # the first that does not fit
        cut = copies.where((F.col("bin") < edge["bin"]) | ((F.col("bin") == edge["bin"]) & (order() < at_row(over)))).agg(F.max(order())).first()[0]
    if cut is None:
        return queued.withColumn("copies", F.lit(0))
    taken = F.size(F.filter(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: order(finish(e)) <= at_row(cut)))
    return queued.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)))


def finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("sent")) / F.col("weight")


def order(finish_time: Column | None = None) -> Column:
    return F.struct((F.col("finish") if finish_time is None else finish_time).alias("finish"), "rank", "key", "doc_id", "size")


def at_row(row) -> Column:
    return F.struct(F.lit(row["finish"]).alias("finish"), F.lit(row["rank"]).alias("rank"), F.lit(row["key"]).alias("key"), F.lit(row["doc_id"]).cast("long").alias("doc_id"), F.lit(row["size"]).cast("long").alias("size"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The documents in the order of the mix, a row for each copy, with epoch and finish; range-sorted over partitions."""
    kept = [f"_doc{i}" for i in range(len(docs.columns))]
    # Rows alike in id, source and size are told apart by number on both sides.
    alike = ["doc_id", "source", "size"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *[F.col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)])
    text = kept[[c.lower() for c in docs.columns].index("text")]
    texts = texts.withColumn("nr", F.row_number().over(Window.partitionBy(*alike).orderBy(F.xxhash64(text))))
    planned = plan(docs, weights, max_epochs).withColumn("nr", F.row_number().over(Window.partitionBy(*alike).orderBy("sent"))).where("copies > 0")
    planned = planned.select(*[F.col(c).alias(f"_{c}") for c in (*alike, "nr")], "source_size", "rank", "weight", "key", "sent", "copies")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*alike, "nr")]
    copies = texts.join(planned.hint("merge"), on).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("finish", finish(F.col("epoch")))
    names = [clear_of("epoch", docs.columns), clear_of("finish", docs.columns)]
    ordered = copies.orderBy("finish", "rank", "key", "doc_id", "size")
    return ordered.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, kept, strict=True)], F.col("epoch").alias(names[0]), F.col("finish").alias(names[1]))


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


REPORT_SQL = r"""
WITH sized AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
level AS (
  SELECT lv AS common FROM (
    SELECT dry, rank, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY dry, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY dry, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
    FROM (SELECT *, CAST(source_size * 3 AS DOUBLE) AS most, source_size * 3 / weight AS dry FROM sources)) WHERE lv <= dry ORDER BY dry, rank LIMIT 1),
queued AS (
  SELECT z.*, s.source_size, s.weight, s.rank, least(CAST(s.source_size * 3 AS DOUBLE), s.weight * (SELECT common FROM level)) AS target,
         sum(size) OVER (PARTITION BY z.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sized z JOIN sources s ON z.source IS NOT DISTINCT FROM s.source),
copies AS (
  SELECT q.*, sum(size) OVER (ORDER BY (e * source_size + sent) / weight, rank, key, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
  FROM queued q, (VALUES (0), (1), (2)) v(e) WHERE size > 0),
given AS (
  SELECT doc_id, key, rank, size, count(*) AS n FROM copies
  WHERE total <= (SELECT sum(size) FROM sized) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(g.n, 0) AS BIGINT) AS taken
FROM queued q LEFT JOIN given g ON q.doc_id = g.doc_id AND q.rank = g.rank AND q.size = g.size
"""
