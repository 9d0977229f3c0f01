"""The corpus pipeline: five operators of plumbline.llm, one after the other, over the documents.

Each stage gets what its predecessor kept, written as Parquet and read again, and all but the last return the columns of
documents. Language ID drops texts of no known language; line dedup takes repeated lines out of texts; near-dedup keeps
one document of each class; decontamination cuts benchmark passages out of texts and drops texts that are mostly such;
mixing repeats and orders documents by target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import dart_minhash, decontaminate, langid, line_dedup, mixing
from plumbline.llm.shared import stash, table


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is that column, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return measured(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

#: Models, signatures and cut spans are not for SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
