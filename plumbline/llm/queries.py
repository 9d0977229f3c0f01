"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import chat, content_sort, dart_minhash, decontaminate, fim, langid, licenses, line_dedup, mixing, pitman_yor, quality, url_filter
from plumbline.llm.shared import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.report(table(spark, sf_dir, "documents"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_forged(table(spark, sf_dir, "conversations")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(table(spark, sf_dir, "pages"))


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.report(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_licenses, op3_pitman_yor, op4_dart_minhash, op5_quality, op6_mixing, op7_langid, op8_line_dedup, op9_chat, op10_url_filter, op11_content_sort, op12_fim)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.REPORT_SQL, "op2_licenses": licenses.REPORT_SQL, "op5_quality": quality.REPORT_SQL, "op6_mixing": mixing.REPORT_SQL, "op8_line_dedup": line_dedup.REPORT_SQL, "op9_chat": chat.REPORT_SQL, "op10_url_filter": url_filter.REPORT_SQL, "op11_content_sort": content_sort.REPORT_SQL, "op12_fim": fim.REPORT_SQL}
