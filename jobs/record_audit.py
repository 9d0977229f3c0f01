"""Replay the recorded measurements of text records as they arrive, and keep the labels of their cells up to date.

    python -m jobs.record_audit --records FOLDER --out FOLDER --checkpoint FOLDER [--config jobs/record_audit.json]

A record has a key, a text, the columns of its cell, and values that were measured on its text when it was recorded. For
every record that has not been taken yet, the job measures the text again and compares. It writes, as Parquet:

* ``ledger``, partitioned by batch and verdict: key, cell, recorded and replayed values and the text's digest. Verdicts:
  ``no_text`` (the text is null), ``unrecorded`` (a value was not recorded), ``mismatch``, ``confirmed``;
* ``revisions``, partitioned by batch: for each key that came in a batch and that has several records by then, how many it
  has and how many different texts are among them; of a key the row of the latest batch counts;
* ``sums``, partitioned by batch: for each cell what the batch adds to it;
* ``cells``, partitioned by label: each cell's records and verdicts over all batches, and the label they earn.

It is a file stream with a checkpoint: a run takes the files that are new since the last one, in batches of at most
``files_per_batch`` files, and ends. A batch overwrites its own partitions only, so a batch that is taken again after a
failure gives the same; a run without new files changes nothing. ``cells`` is made of ``sums``, which has a few
rows a batch, at the end of every run.

A record without key has no revisions. Keys that are equal and texts that are equal are records of their own. Records with
a null cell are a cell. What is compared with earlier batches are digests by key; no batch is held in memory or collected.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import atlas

log = logging.getLogger("jobs.record_audit")
CONFIG = Path(__file__).with_suffix(".json")
VERDICTS = ("confirmed", "mismatch", "unrecorded", "no_text")


def audited(records: DataFrame, config: dict) -> DataFrame:
    """key, the cell's columns, each recorded value with its replayed_ one, text_sha256 and verdict."""
    text, kinds = F.col(config["text"]), dict(records.dtypes)
    again = {name: F.expr(how).cast(kinds[name]) for name, how in config["recorded"].items()}
    unrecorded = reduce(lambda a, b: a | b, [F.col(name).isNull() for name in again])
    differs = reduce(lambda a, b: a | b, [~F.col(name).eqNullSafe(v) for name, v in again.items()])
    verdict = F.when(text.isNull(), "no_text").when(unrecorded, "unrecorded").when(differs, "mismatch").otherwise("confirmed")
    return records.select(F.col(config["key"]).alias("key"), *config["cell"], *again, *[v.alias(f"replayed_{n}") for n, v in again.items()], F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"), verdict.alias("verdict"))


def sums(ledger: DataFrame, cell: list[str]) -> DataFrame:
    """What records add to their cells: how many, and how many of each verdict."""
    return ledger.groupBy(*cell).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def revisions(ledger: DataFrame, touched: DataFrame) -> DataFrame:
    """(key, records, versions) of the touched keys with several records in the ledger.

    Equal (key, digest) pairs are counted before keys are, on the map side, so that a key that a third of all records have
    is one row a task.
    """
    mine = ledger.where("key is not null").join(touched, "key", "left_semi")
    versions = mine.groupBy("key", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    return versions.groupBy("key").agg(F.sum("n").alias("records"), F.count("text_sha256").alias("versions")).where("records > 1")


def labelled(made: DataFrame, cell: list[str], policy: atlas.Policy) -> DataFrame:
    """Cells of sums with their label: a record whose values differ from its text's is a risk of 1, and a fact."""
    total = made.groupBy(*cell).agg(*[F.sum(c).alias(c) for c in ("records", *VERDICTS)])
    broken, read = F.col("mismatch"), F.col("confirmed") + F.col("mismatch")
    told = {"samples": read, "risk_sum": broken.cast("double"), "risk_max": F.when(broken > 0, 1.0).otherwise(0.0), "strong": broken > 0, "non_finite": F.lit(False), "measured": F.lit(1), "depth": F.lit(0)}
    return total.withColumns(told).withColumn("label", atlas.classify(policy)).select(*cell, "records", *VERDICTS, "label")


class Tables:
    """The tables below a folder, with schemas told, so that those without rows or files yet can be read."""

    def __init__(self, spark: SparkSession, records: T.StructType, out: str, config: dict) -> None:
        self.spark, self.out = spark, out
        cell = [records[c] for c in config["cell"]]
        key = T.StructField("key", records[config["key"]].dataType)
        values = [records[c] for c in config["recorded"]]
        counts = [T.StructField(c, T.LongType()) for c in ("records", *VERDICTS)]
        batch = T.StructField("batch", T.LongType())
        self.schemas = {
            "ledger": T.StructType([key, *cell, *values, *[T.StructField(f"replayed_{v.name}", v.dataType) for v in values], T.StructField("text_sha256", T.StringType()), batch, T.StructField("verdict", T.StringType())]),
            "revisions": T.StructType([key, T.StructField("records", T.LongType()), T.StructField("versions", T.LongType()), batch]),
            "sums": T.StructType([*cell, *counts, batch]),
            "cells": T.StructType([*cell, *counts, T.StructField("label", T.StringType())]),
        }
        self.by = {"ledger": ["batch", "verdict"], "revisions": ["batch"], "sums": ["batch"], "cells": ["label"]}

    def at(self, name: str) -> str:
        return f"{self.out}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(self.at(name))

    def make(self) -> None:
        """Folders that can be read; what is in them stays."""
        for name, schema in self.schemas.items():
            self.spark.createDataFrame([], schema).write.mode("append").partitionBy(*self.by[name]).parquet(self.at(name))

    def put(self, df: DataFrame, name: str, mode: str = "dynamic") -> int:
        """Write df in place of the partitions it has rows for (dynamic) or of the whole table (static)."""
        seen = Observation()
        ready = df.select(*self.schemas[name].fieldNames()).observe(seen, F.count(F.lit(1)).alias("rows"))
        ready.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*self.by[name]).parquet(self.at(name))
        return seen.get["rows"]


def take(tables: Tables, records: DataFrame, batch: int, config: dict) -> None:
    """Write one batch: its ledger first, the rest from the ledger as it was written."""
    at = F.lit(batch).cast("long").alias("batch")
    read = tables.put(audited(records, config).select("*", at), "ledger")
    ledger = tables.read("ledger").where(F.col("batch") <= batch)
    mine = ledger.where(F.col("batch") == batch)
    added = tables.put(sums(mine, config["cell"]).select("*", at), "sums")
    again = tables.put(revisions(ledger, mine.where("key is not null").select("key").distinct()).select("*", at), "revisions")
    log.info("batch %d: read %d records, wrote them to %s, %d sums of cells and %d keys with several records", batch, read, tables.at("ledger"), added, again)


def run(spark: SparkSession, records: str, out: str, checkpoint: str, config: dict) -> Tables:
    """Take what is new below records, a path of Parquet files, and bring the tables below out up to date."""
    schema = spark.read.parquet(records).schema
    tables = Tables(spark, schema, out, config)
    tables.make()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(records)
    wanted = [config["key"], config["text"], *config["cell"], *config["recorded"]]
    writer = stream.select(*dict.fromkeys(wanted)).writeStream.foreachBatch(lambda df, batch: take(tables, df, batch, config))
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    cells = tables.put(labelled(tables.read("sums"), config["cell"], atlas.Policy(**config["policy"])), "cells", "static")
    log.info("read %s: now %d cells in %s", records, cells, tables.at("cells"))
    return tables


def latest(tables: Tables) -> DataFrame:
    """Each key's row of the latest batch that has one."""
    return tables.read("revisions").groupBy("key").agg(F.max_by(F.struct("records", "versions"), "batch").alias("r")).select("key", "r.*")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name, default in (("--records", None), ("--out", None), ("--checkpoint", None), ("--config", str(CONFIG)), ("--master", None)):
        parser.add_argument(name, default=default, required=name in ("--records", "--out", "--checkpoint"))
    told = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("record_audit")
    spark = (builder.master(told.master) if told.master else builder).getOrCreate()
    try:
        run(spark, told.records, told.out, told.checkpoint, json.loads(Path(told.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
