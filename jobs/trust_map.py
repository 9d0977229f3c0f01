"""Map where the rules of a model hold over the rows of a table.

    python -m jobs.trust_map --table TABLE --out FOLDER [--config jobs/trust_map.json] [--master local[8]]

The config names the model (its text, whose inputs have domains), a SQL expression over the table for each input, the
columns that name a row, how often each axis of the domain is halved, how near to a rule's edge risk begins, and the
labels' policy. The job evaluates the model on every row and writes, as Parquet:

* ``cells``, partitioned by label: each cell of the domain with its samples, facts, risk and bounds;
* ``findings``, partitioned by rule: each row that breaks a rule, and by how much;
* ``outside``, partitioned by reason: rows with an input that is missing or outside its domain, which are in no cell.

It writes whole tables in place of those that are there, from the input alone: running it again gives the same, and mends
what a run that was broken off has left. Rows of outside break no rule: a model says nothing beyond its domain.
A table without rows gives tables without rows. Columns of the key may have any name but rule, magnitude, x and reason, which
are the job's own.
"""

from __future__ import annotations

import argparse
import json
import logging
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import ieee
from plumbline.lang import columns, lanes
from plumbline.lang.model import Model, compile_model
from plumbline.operators import atlas, evidence

log = logging.getLogger("jobs.trust_map")
CONFIG = Path(__file__).with_suffix(".json")
#: Bits of the channels that this job measures.
PHYSICAL, NUMERICAL = 2, 4


def place(model: Model, x: Column) -> Column:
    """Why a row is in no cell: missing or outside; null where it is in one."""
    values = [F.get(x, F.lit(i)) for i in range(len(model.params))]
    missing = reduce(lambda a, b: a | b, [v.isNull() | F.isnan(v) for v in values])
    outside = reduce(lambda a, b: a | b, [~(ieee.ge(v, F.lit(float(p.lo))) & ieee.le(v, F.lit(float(p.hi)))) for v, p in zip(values, model.params, strict=True)])
    return F.when(missing, "missing").when(outside, "outside")


def observed(table: DataFrame, model: Model, config: dict) -> DataFrame:
    """The table's keys and inputs: key (a struct, so that no name of the table meets one of ours), x, reason."""
    x = F.array(*[F.expr(config["inputs"][p.name]).cast("double") for p in model.params])
    return table.select(F.struct(*config["key"]).alias("key"), x.alias("x")).withColumn("reason", place(model, F.col("x")))


def judged(rows: DataFrame, model: Model, near: float) -> DataFrame:
    """Rows with the model's results and risk: 1 where a rule is broken, else rising from 0 as the nearest edge comes up."""
    made = columns.run_model(rows, model) if columns.expressible(model) else lanes.run_model(rows, model)
    rules = columns.rules_of(model)
    fact, flagged = evidence.violates(rules, F.col("y")), F.col("flags") != 0
    close = F.pow(F.greatest(F.lit(0.0), 1 - evidence.level(rules) / near), F.lit(2.0)) if rules else F.lit(0.0)
    channels = F.when(fact, PHYSICAL).otherwise(0).bitwiseOR(F.when(flagged, NUMERICAL).otherwise(0))
    return made.withColumns({"fact": fact, "risk": F.when(fact, 1.0).otherwise(close), "channels": channels, "measured": F.lit(PHYSICAL | NUMERICAL)})


def written(df: DataFrame, path: str, by: str) -> int:
    """Write df in place of what is at path, partitioned; how many rows it had."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(by).parquet(path)
    rows = seen.get["rows"]
    log.info("wrote %d rows to %s by %s", rows, path, by)
    return rows


def run(spark: SparkSession, table: str, out: str, config: dict) -> dict[str, int]:
    """Read the table at a path, write the three tables below out, and say how many rows each has."""
    model = compile_model(config["model"])
    bounds = [(float(p.lo), float(p.hi)) for p in model.params]
    given = spark.read.parquet(table)
    rows = observed(given, model, config)
    known = judged(rows.where("reason is null"), model, config["near"])
    cells = atlas.grid_cells(known, bounds, config["splits"], policy=atlas.Policy(**config["policy"]))
    broken = evidence.constraints(known.withColumn("id", F.lit(0)), columns.rules_of(model), ["key"])
    made = {
        "cells": written(cells.select("k", "lo", "hi", "samples", "facts", "channels", "risk_sum", "risk_max", "label"), f"{out}/cells", "label"),
        "findings": written(broken.select("key.*", F.col("subject").alias("rule"), "magnitude"), f"{out}/findings", "rule"),
        "outside": written(rows.where("reason is not null").select("key.*", "x", "reason"), f"{out}/outside", "reason"),
    }
    log.info("read %s: model %s, %d cells, %d findings, %d rows in no cell", table, model.name, made["cells"], made["findings"], made["outside"])
    return made


SCHEMAS = {
    "cells": "k array<int>, lo array<double>, hi array<double>, samples long, facts long, channels int, risk_sum double, risk_max double, label string",
    "findings": "{key}, rule string, magnitude double",
    "outside": "{key}, x array<double>, reason string",
}


def read(spark: SparkSession, table: str, out: str, config: dict) -> dict[str, DataFrame]:
    """The three tables, by name; the schema is told, so that tables without rows can be read."""
    key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(table).select(*config["key"]).schema)
    return {name: spark.read.schema(schema.format(key=key)).parquet(f"{out}/{name}") for name, schema in SCHEMAS.items()}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name, default in (("--table", None), ("--out", None), ("--config", str(CONFIG)), ("--master", None)):
        parser.add_argument(name, default=default, required=name in ("--table", "--out"))
    told = parser.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("trust_map")
    spark = (builder.master(told.master) if told.master else builder).getOrCreate()
    try:
        run(spark, told.table, told.out, json.loads(Path(told.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
