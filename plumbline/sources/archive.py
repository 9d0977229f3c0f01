"""Archives of campaigns: Parquet tables and a manifest with their digests; reading, checking, replaying, comparing."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lang.model import Model, from_text, to_text
from plumbline.lang.scalar import compiled
from plumbline.operators import compare
from plumbline.plans.campaign import Campaign

SCHEMA = "plumbline.archive/1"
TABLES = {
    "observations": "id long, x array<double>, y array<double>, traces array<array<double>>, flags int, steps long, online_risk double, final_risk double",
    "probes": "base long, perturbed long, axis int",
    "swaps": "base long, swapped long, a int, b int",
    "cells": "cell int, seq int, depth int, label string, samples long, mean_risk double, max_risk double, channels int, measured int, lo array<double>, hi array<double>",
    "bands": "axis int, lo double, hi double, facing_lo double, facing_hi double, transitions int",
    "decisions": "evaluation long, family string, cell int, risk double, gain double, x array<double>",
    "evidence": "channel string, subject string, magnitude double, strength double, observations array<long>, fixed boolean",
    "findings": "cell int, cells array<int>, lo array<double>, hi array<double>, representative array<double>, observation long, online_risk double, final_risk double, samples long, signature array<string>",
}


def tables(spark: SparkSession, c: Campaign) -> dict[str, DataFrame]:
    """A finished campaign as DataFrames."""
    cells = [tuple(x[k] for k in ("cell", "seq", "depth", "label", "samples", "mean_risk", "max_risk", "channels", "measured", "lo", "hi")) for x in c.space.table()]
    rows = {
        "observations": [(o.id, o.x, o.y, o.traces, o.flags, o.steps, a, b) for o, a, b in zip(c.records, c.online, c.risks, strict=True)],
        "probes": c.pairs.probes,
        "swaps": c.pairs.swaps,
        "cells": cells,
        "bands": [tuple(b[k] for k in ("axis", "lo", "hi", "facing_lo", "facing_hi", "transitions")) for b in c.space.edges()],
        "decisions": [tuple(d[k] for k in ("evaluation", "family", "cell", "risk", "gain", "x")) for d in c.decisions],
        "evidence": [(e.channel, e.subject, e.magnitude, e.strength, e.observations, e.fixed) for s in c.sets for e in c.scales.apply(s)],
        "findings": [(f["cell"], f["cells"], [b[0] for b in f["bounds"]], [b[1] for b in f["bounds"]], f["representative"], f["observation"], f["online_risk"], f["final_risk"], f["samples"], f["signature"]) for f in c.findings],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in TABLES.items()}


def digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order and partitions: sums of parts of each row's SHA-256, and the count."""
    sha = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda k: F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    row = df.agg(F.count("*").cast("string"), *[part(k) for k in range(4)]).first()
    return "-".join(v or "0" for v in row)


def write(spark: SparkSession, c: Campaign, path: str) -> dict:
    """Write a campaign to a new folder; an existing one is refused. Returns the manifest."""
    made = tables(spark, c)
    for name, df in made.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    config = {k: v for k, v in vars(c.c).items() if k != "policy"} | {"policy": vars(c.c.policy)}
    manifest = {
        "schema": SCHEMA, "model": c.m.name, "model_text": to_text(c.m), "config": config, "counts": {"evaluations": c.evaluations, "steps": c.steps, "unplaced": c.space.outside, "cells": len(c.space.leaves), "findings": len(c.findings)},
        "coverage": c.space.shares(), "calibration": {"channel": c.scales.channel, "claim": {"|".join(k): v for k, v in c.scales.claim.items()}}, "correlation": {"|".join(k): v for k, v in c.rho.items()},
        "environment": {"python": platform.python_version(), "spark": spark.version}, "digests": {name: digest(spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")) for name in made},
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


class Archive:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))  # one line
        if self.manifest.get("schema") != SCHEMA:
            raise ValueError(f"{path} is no archive of {SCHEMA}")
        self.tables = {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}

    @property
    def model(self) -> Model:
        return from_text(self.manifest["model_text"])

    def damaged(self) -> list[str]:
        """Tables whose digest is not the manifest's."""
        return [name for name, df in self.tables.items() if digest(df) != self.manifest["digests"].get(name)]

    def replay(self) -> DataFrame:
        """Observations that do not come out the same, bit by bit, when run again: id and what differs."""
        text, limit = self.manifest["model_text"], self.manifest["config"]["max_steps"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            again = compiled(from_text(text), False, limit)
            bits = lambda v: np.asarray(v, np.float64).tobytes()
            for f in frames:
                rows = []
                for o in f.itertuples(index=False):
                    r = again([float(v) for v in o.x])
                    parts = {"outputs": bits(r.y) != bits(list(o.y)), "flags": r.flags != o.flags, "steps": r.steps != o.steps, "traces": [bits(t) for t in r.traces] != [bits(list(t)) for t in o.traces]}
                    if any(parts.values()):
                        rows.append((o.id, ",".join(k for k, v in parts.items() if v)))
                yield pd.DataFrame(rows, columns=["id", "differs"])

        return self.tables["observations"].mapInPandas(run, "id long, differs string")


def fields(spark: SparkSession, a: Archive) -> DataFrame:
    """(section, path, value) of everything that two archives are compared by."""
    wanted = {k: a.manifest[k] for k in ("model", "config", "counts", "coverage", "calibration", "correlation")}
    rows = [(k, p, v) for k, part in wanted.items() for p, v in compare.flattened(part, k)]
    out = spark.createDataFrame(rows, "section string, path string, value string")
    cells = a.tables["cells"].select(F.lit("cells"), F.concat_ws(":", F.concat_ws(",", F.col("lo").cast("array<string>")), F.concat_ws(",", F.col("hi").cast("array<string>"))), "label")
    bands = a.tables["bands"].select(F.lit("bands"), F.concat_ws(":", "axis", "lo", "hi"), F.col("transitions").cast("string"))
    return out.union(cells).union(bands)


def compared(spark: SparkSession, a: Archive, b: Archive) -> DataFrame:
    """section, path, a, b and status of every field; findings are paired by their box."""
    rest = compare.fields(fields(spark, a), fields(spark, b), ["section", "path"])
    box = lambda x: x.tables["findings"].select(F.concat_ws(":", F.concat_ws(",", F.col("lo").cast("array<string>")), F.concat_ws(",", F.col("hi").cast("array<string>"))).alias("region"), "observation")
    found = compare.paired(box(a), box(b), "region", "observation")
    status = F.when(F.col("status") == "paired", F.when(F.col("a") == F.col("b"), "same").otherwise("changed")).otherwise(F.col("status"))
    both = rest.union(found.select(F.lit("findings"), "region", F.col("a").cast("string"), F.col("b").cast("string"), status))
    return compare.skipping(both, len(a.model.params), len(b.model.params))


def to_csv(cells: DataFrame, path: str, axes: Sequence[str]) -> None:
    """The atlas as CSV with six decimals."""
    six = lambda c: F.format_string("%.6f", F.col(c) if isinstance(c, str) else c)
    bounds = [six(F.get(side, F.lit(i))).alias(f"{side}_{name}") for i, name in enumerate(axes) for side in ("lo", "hi")]
    cells.orderBy("seq").select("cell", "depth", "label", "samples", six("mean_risk").alias("mean_risk"), six("max_risk").alias("max_risk"), *bounds).coalesce(1).write.option("header", True).csv(path)
