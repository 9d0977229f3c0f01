"""Texts of models are dealt over tasks by their number, and compiled once where they are equal."""

from pyspark.sql import functions as F

from plumbline.plans.model_queries import told_of_texts


def test_texts_of_one_file_are_dealt_over_tasks(spark):
    good = F.concat(F.lit("model part { input a in [0, "), (F.col("id") % 7 + 1).cast("string"), F.lit("] input l : km in [1, 2] let y = a * 2 + 1 }"))
    text = F.when(F.col("id") % 5 == 0, F.lit("model part { input x in [2, 1] }")).otherwise(good)
    made = told_of_texts(spark.range(200).coalesce(1).select(F.col("id").alias("p_partkey"), text.alias("text")))
    assert made.rdd.getNumPartitions() == 4  # the session's shuffle partitions, however few bytes there are
    rows = {r.p_partkey: r for r in made.collect()}
    assert set(rows) == set(range(200))
    assert all((r.refusal is not None) == (k % 5 == 0) for k, r in rows.items())
    assert {(r.inputs, r.outputs, r.rules, r.same, r.runs, r.dimension) for r in rows.values() if r.refusal is None} == {(2, 1, 0, True, "columns,lanes,scalar", "m")}
