"""The jobs as queries: each runs twice into one new folder and gives the whole output as it stands then."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import record_audit, trust_map
from plumbline.plans.scratch import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def _nothing(**kinds: str) -> dict:
    return {name: F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()}


def job1_trust_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, findings and rows outside the domain of line prices over lineitem, told apart by kind."""
    config, table, out = json.loads(trust_map.CONFIG.read_text()), f"{sf_dir}/lineitem.parquet", _folder(spark, "trust_map")
    for _ in range(2):
        trust_map.run(spark, table, out, config)
    made = trust_map.read(spark, table, out, config)
    keys = [F.col(c).cast("long").alias(c) for c in config["key"]]
    none = _nothing(k0="int", k1="int", k2="int", samples="long", facts="long", mean_risk="double", risk_max="double", l_orderkey="long", l_linenumber="long", magnitude="double")
    cells = made["cells"].select(
        F.lit("cell").alias("kind"), F.col("label").alias("name"), *[F.get("k", F.lit(i)).alias(f"k{i}") for i in range(3)], "samples", "facts", F.round(F.col("risk_sum") / F.col("samples"), 9).alias("mean_risk"), F.round("risk_max", 9).alias("risk_max"), none["l_orderkey"], none["l_linenumber"], none["magnitude"]
    )
    blank = [none[c] for c in ("k0", "k1", "k2", "samples", "facts", "mean_risk", "risk_max")]
    findings = made["findings"].select(F.lit("finding").alias("kind"), F.col("rule").alias("name"), *blank, *keys, F.round("magnitude", 9).alias("magnitude"))
    outside = made["outside"].select(F.lit("outside").alias("kind"), F.col("reason").alias("name"), *blank, *keys, none["magnitude"])
    return cells.unionByName(findings).unionByName(outside)


def job2_record_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of documents with how many records and texts their key has, and the cells with their labels, by kind.

    The path is a pattern, as documents may be a folder or one file, and a file stream of one plain path wants a folder.
    """
    config, records, out = json.loads(record_audit.CONFIG.read_text()), f"{sf_dir}/documents.parque[t]", _folder(spark, "record_audit")
    for _ in range(2):
        tables = record_audit.run(spark, records, f"{out}/tables", f"{out}/checkpoint", config)
    ledger = tables.read("ledger").join(record_audit.latest(tables), "key", "left")
    none = _nothing(doc_id="long", n_chars="long", replayed_n_chars="long", text_sha256="string", versions="long", confirmed="long", mismatch="long", unrecorded="long", no_text="long")
    counts = list(record_audit.VERDICTS)
    one = F.when(F.col("key").isNotNull(), F.lit(1).cast("long"))
    texts = F.when(F.col("key").isNotNull(), F.col("text_sha256").isNotNull().cast("long"))
    documents = ledger.select(F.lit("record").alias("kind"), F.col("verdict").alias("name"), F.col("key").alias("doc_id"), "lang", "source", "n_chars", "replayed_n_chars", "text_sha256", F.coalesce("records", one).alias("records"), F.coalesce("versions", texts).alias("versions"), *[none[c] for c in counts])
    cells = tables.read("cells").select(F.lit("cell").alias("kind"), F.col("label").alias("name"), none["doc_id"], "lang", "source", none["n_chars"], none["replayed_n_chars"], none["text_sha256"], "records", none["versions"], *counts)
    return documents.unionByName(cells)


JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_trust_map, job2_record_audit)}

SQL = {
    "job1_trust_map": """
WITH given AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_discount AS DOUBLE) AS d FROM lineitem),
placed AS (
  SELECT *, CASE WHEN q IS NULL OR p IS NULL OR d IS NULL OR isnan(q) OR isnan(p) OR isnan(d) THEN 'missing'
                 WHEN NOT (q BETWEEN 1 AND 50 AND p BETWEEN 900 AND 105000 AND d BETWEEN 0 AND 0.1) THEN 'outside' END AS reason FROM given),
model AS (
  SELECT *, p / q AS unit, p * (1 - d) AS net FROM placed WHERE reason IS NULL),
judged AS (
  SELECT *, unit > 40000 OR net > 100000 AS fact, least((40000 - unit) / greatest(unit, 40000), (100000 - net) / greatest(net, 100000), 1.0) AS level FROM model),
risky AS (
  SELECT *, CASE WHEN fact THEN 1.0 ELSE pow(greatest(0.0, 1 - level / 0.25), 2) END AS risk,
         CAST(greatest(ceil((q - 1) / (49.0::DOUBLE / 8)) - 1, 0) AS INT) AS k0, CAST(greatest(ceil((p - 900) / (104100.0::DOUBLE / 8)) - 1, 0) AS INT) AS k1,
         CAST(greatest(ceil(d / (0.1::DOUBLE / 2)) - 1, 0) AS INT) AS k2 FROM judged),
cells AS (
  SELECT k0, k1, k2, count(*) AS samples, CAST(count(*) FILTER (fact) AS BIGINT) AS facts, sum(risk) / count(*) AS mean_risk, max(risk) AS risk_max, bool_or(risk >= 0.45 AND fact) AS strong
  FROM risky GROUP BY ALL)
SELECT 'cell' AS kind, CASE WHEN risk_max >= 0.7 OR mean_risk >= 0.45 THEN CASE WHEN strong THEN 'SUSPICIOUS' ELSE 'UNKNOWN' END WHEN samples < 4 THEN 'UNKNOWN' ELSE 'TRUSTED' END AS name,
       k0, k1, k2, samples, facts, round(mean_risk, 9) AS mean_risk, round(risk_max, 9) AS risk_max, CAST(NULL AS BIGINT) AS l_orderkey, CAST(NULL AS BIGINT) AS l_linenumber, CAST(NULL AS DOUBLE) AS magnitude FROM cells
UNION ALL
SELECT 'finding', rule, NULL, NULL, NULL, NULL, NULL, NULL, NULL, l_orderkey, l_linenumber, round(magnitude, 9)
FROM (SELECT 'require0' AS rule, l_orderkey, l_linenumber, (unit - 40000) / unit AS magnitude FROM judged WHERE unit > 40000
      UNION ALL SELECT 'require1', l_orderkey, l_linenumber, (net - 100000) / net FROM judged WHERE net > 100000)
UNION ALL
SELECT 'outside', reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL, l_orderkey, l_linenumber, NULL FROM placed WHERE reason IS NOT NULL
""",
    "job2_record_audit": """
WITH ledger AS (
  SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS replayed_n_chars, sha256(text) AS text_sha256,
         CASE WHEN text IS NULL THEN 'no_text' WHEN n_chars IS NULL THEN 'unrecorded' WHEN n_chars <> length(text) THEN 'mismatch' ELSE 'confirmed' END AS verdict FROM documents),
keys AS (SELECT doc_id, count(*) AS records, count(DISTINCT text_sha256) AS versions FROM ledger GROUP BY doc_id),
cells AS (
  SELECT lang, source, count(*) AS records, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'mismatch') AS mismatch,
         count(*) FILTER (verdict = 'unrecorded') AS unrecorded, count(*) FILTER (verdict = 'no_text') AS no_text FROM ledger GROUP BY lang, source)
SELECT 'record' AS kind, verdict AS name, l.doc_id, lang, source, n_chars, replayed_n_chars, text_sha256, CASE WHEN l.doc_id IS NOT NULL THEN records END AS records,
       CASE WHEN l.doc_id IS NOT NULL THEN versions END AS versions, CAST(NULL AS BIGINT) AS confirmed, CAST(NULL AS BIGINT) AS mismatch, CAST(NULL AS BIGINT) AS unrecorded, CAST(NULL AS BIGINT) AS no_text
FROM ledger l LEFT JOIN keys k ON l.doc_id = k.doc_id
UNION ALL
SELECT 'cell', CASE WHEN mismatch > 0 AND mismatch >= 0.45 * (confirmed + mismatch) THEN 'SUSPICIOUS' WHEN confirmed + mismatch < 4 THEN 'UNKNOWN' ELSE 'TRUSTED' END,
       NULL, lang, source, NULL, NULL, NULL, records, NULL, confirmed, mismatch, unrecorded, no_text FROM cells
""",
}
