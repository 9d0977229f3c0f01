"""Comparing records: field by field, documents by path, files by digest."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.scratch import stash


def fields(a: DataFrame, b: DataFrame, on: Sequence[str], value: str = "value") -> DataFrame:
    """A full outer join on the key: status same, changed, only_a or only_b."""
    left = a.select(*on, F.col(value).alias("a"), F.lit(1).alias("_a"))
    right = b.select(*on, F.col(value).alias("b"), F.lit(1).alias("_b"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return left.join(right, list(on), "full").select(*on, "a", "b", status.alias("status"))


def tally(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return compared.groupBy(*by).agg(n("same"), n("changed"), n("only_a"), n("only_b"), n("skipped"))


def verdict(compared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (or one of each by): differing, else not fully comparable where something was skipped, else identical."""
    odd = F.count_if(~F.col("status").isin("same", "skipped"))
    return compared.groupBy(*by).agg(F.when(odd > 0, "differing").when(F.count_if(F.col("status") == "skipped") > 0, "not fully comparable").otherwise("identical").alias("verdict"))


def skipping(compared: DataFrame, arity_a: int, arity_b: int, sections: Sequence[str] = ("cells", "bands", "findings")) -> DataFrame:
    """Between spaces of different arity geometry cannot be compared: its fields are skipped, not different."""
    if arity_a == arity_b:
        return compared
    return compared.withColumn("status", F.when(F.col("section").isin(list(sections)), "skipped").otherwise(F.col("status")))


def paired(a: DataFrame, b: DataFrame, region: str, order: str) -> DataFrame:
    """Rows of a and b with the same region text, first with first: a multiset pairing. status as in fields()."""
    nth = lambda d: d.withColumn("_nth", F.row_number().over(Window.partitionBy(region).orderBy(order)))
    left = nth(a).select(region, "_nth", F.col(order).alias("a"))
    right = nth(b).select(region, "_nth", F.col(order).alias("b"))
    status = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("paired")
    return left.join(right, [region, "_nth"], "full").select(region, "a", "b", status.alias("status"))


def flattened(document: object, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, JSON of the value) of every leaf."""
    if isinstance(document, dict) and document:
        for k, v in document.items():
            yield from flattened(v, f"{path}.{k}" if path else k)
    elif isinstance(document, list) and document:
        for i, v in enumerate(document):
            yield from flattened(v, f"{path}[{i}]")
    else:
        yield path, json.dumps(document, sort_keys=True)


def json_paths(documents: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """keys, path, value: every leaf of JSON texts, value being its JSON; a text that is no JSON, or names a key of an object
    twice, has none. Empty objects and lists are leaves.

    Texts are parsed once, into variants; each step explodes what still has something inside, level by level.
    """
    k = list(keys)
    spark = documents.sparkSession
    rows = documents.select(*k, F.lit("").alias("_path"), F.try_parse_json(F.col(text)).alias("_v")).where("_v is not null")
    leaves: list[DataFrame] = []
    while True:
        whole, kind = F.to_json("_v"), F.schema_of_variant("_v")
        inner = (kind.startswith("OBJECT") & (whole != "{}")) | (kind.startswith("ARRAY") & (whole != "[]"))
        level = stash(rows.select(*k, "_path", F.when(~inner, whole).alias("_leaf"), F.when(inner, F.col("_v")).alias("_v")), "json-level")
        leaves.append(level.where("_v is null").select(*k, F.col("_path").alias("path"), F.col("_leaf").alias("value")))
        deeper = level.where("_v is not null").select(*k, "_path", "_v")
        if deeper.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        exploded = spark.sql("SELECT d.*, e.pos AS _pos, e.key AS _key, e.value AS _value FROM {d} AS d, LATERAL variant_explode(_v) AS e", d=deeper)
        step = F.when(F.col("_key").isNull(), F.concat("_path", F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).when(F.col("_path") == "", F.col("_key")).otherwise(F.concat("_path", F.lit("."), "_key"))
        rows = exploded.select(*k, step.alias("_path"), F.col("_value").alias("_v"))


def tampered(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names whose digest in the manifest (name, sha256) no file (name, content) has: an anti join."""
    have = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return manifest.join(have, ["name", "sha256"], "left_anti")
