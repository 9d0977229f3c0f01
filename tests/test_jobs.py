"""The jobs, on copies: runs that repeat, grow, are broken off and find edge cases; and their command lines."""

import hashlib
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import record_audit, trust_map

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LINES = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, note string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, batch string, key string"


def rows_of(tables):
    return {name: sorted(map(str, df.select(*sorted(df.columns)).collect())) for name, df in tables.items()}


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


# ---- the map of trust


def lines():
    rows = [(i, 1, 1.0 + i % 50, 900.0 + 1000 * (i % 100), (i % 11) / 100, "n") for i in range(600)]
    return [*rows, rows[0], (None, None, 1.0, 90_000.0, 0.0, None), (699, 2, 50.0, 104_000.0, 0.0, "n"), (700, 1, None, 1000.0, 0.0, "n"), (701, 1, 5.0, float("nan"), 0.0, "n"), (702, 1, 51.0, 1000.0, 0.0, "n"), (703, 1, 1.0, 900.0, 0.1, "n"), (704, 1, 1.0, float("inf"), 0.1, "n")]


@pytest.fixture
def config():
    return json.loads(trust_map.CONFIG.read_text())


def test_trust_map(spark, tmp_path, config):
    table, out = f"{tmp_path}/lines", f"{tmp_path}/out"
    spark.createDataFrame(lines(), LINES).repartition(3).write.parquet(table)
    made = trust_map.run(spark, table, out, config)
    tables = trust_map.read(spark, table, out, config)
    inside = [r for r in lines() if r[2] is not None and 1 <= r[2] <= 50 and r[3] == r[3] and r[3] <= 105_000 and r[4] <= 0.1]
    broken = [(r[0], rule) for r in inside for rule, bad in (("require0", r[3] / r[2] > 40_000), ("require1", r[3] * (1 - r[4]) > 100_000)) if bad]
    assert sorted((str(r.l_orderkey), r.rule) for r in tables["findings"].collect()) == sorted((str(k), rule) for k, rule in broken)
    assert sorted((r.l_orderkey, r.reason) for r in tables["outside"].collect()) == [(700, "missing"), (701, "missing"), (702, "outside"), (704, "outside")]
    total = tables["cells"].agg(F.sum("samples").alias("n"), F.sum("facts").alias("facts"), F.count("*").alias("cells")).first()
    assert (total.n, total.facts, total.cells) == (len(inside), len({(k, i) for i, (k, _) in enumerate(broken)}), made["cells"])
    assert made["findings"] == len(broken) and made["outside"] == 4
    assert {p for p in os.listdir(f"{out}/findings") if "=" in p} == {"rule=require0", "rule=require1"}
    first = rows_of(tables)
    trust_map.run(spark, table, out, config)
    assert rows_of(trust_map.read(spark, table, out, config)) == first


def test_trust_map_takes_the_place_of_what_was_there(spark, tmp_path, config):
    table, out = f"{tmp_path}/lines", f"{tmp_path}/out"
    spark.createDataFrame(lines(), LINES).write.parquet(table)
    trust_map.run(spark, table, out, config)
    spark.createDataFrame([(1, 1, 2.0, 1000.0, 0.0, "n")] * 5, LINES).write.mode("overwrite").parquet(table)
    assert trust_map.run(spark, table, out, config) == {"cells": 1, "findings": 0, "outside": 0}
    tables = trust_map.read(spark, table, out, config)
    assert [(r.samples, r.label) for r in tables["cells"].collect()] == [(5, "TRUSTED")]
    assert tables["findings"].count() == tables["outside"].count() == 0
    spark.createDataFrame([], LINES).write.mode("overwrite").parquet(table)
    assert trust_map.run(spark, table, out, config) == {"cells": 0, "findings": 0, "outside": 0}


def test_trust_map_of_a_model_with_a_loop(spark, tmp_path):
    table, out = f"{tmp_path}/steps", f"{tmp_path}/out"
    spark.createDataFrame([(i, i / 100) for i in range(1, 31)], "id long, dt double").write.parquet(table)
    model = "model spring { input dt in [0.001, 0.3] state x = 1.0 state v = 0.0 loop 41 { let before = x advance x = x + v * dt advance v = v - before * dt } require x <= 2.0 }"
    config = {"model": model, "inputs": {"dt": "dt"}, "key": ["id"], "splits": [2], "near": 0.1, "policy": {"min_samples": 2}}
    trust_map.run(spark, table, out, config)

    def last(dt):
        x, v = 1.0, 0.0
        for _ in range(41):
            x, v = x + v * dt, v - x * dt
        return x

    assert sorted(r.id for r in trust_map.read(spark, table, out, config)["findings"].collect()) == [i for i in range(1, 31) if last(i / 100) > 2.0]


# ---- the audit of records


def documents(ids, **more):
    """(id, text, ...) of which some measurements are wrong or missing."""
    out = []
    for i in ids:
        text = None if i % 11 == 0 else "" if i % 13 == 0 else f"texté {i}" * (1 + i % 4) + more.get("end", "")
        n = None if i % 7 == 0 else (len(text or "") + (i % 5 == 0))
        out.append((None if i % 17 == 0 else i, text, "en" if i % 2 else "de", None if i % 3 == 0 else "src", n, "b", "k"))
    return out


def brute_ledger(rows):
    verdict = lambda t, n: "no_text" if t is None else "unrecorded" if n is None else "confirmed" if n == len(t) else "mismatch"
    return sorted(str((i, lang, s, n, None if t is None else len(t), None if t is None else hashlib.sha256(t.encode()).hexdigest(), verdict(t, n))) for i, t, lang, s, n, _, _ in rows)


def ledger_of(tables):
    return sorted(str(tuple(r)) for r in tables.read("ledger").select("key", "lang", "source", "n_chars", "replayed_n_chars", "text_sha256", "verdict").collect())


def cells_of(tables):
    return sorted(str(tuple(r)) for r in tables.read("cells").select("lang", "source", "records", *record_audit.VERDICTS, "label").collect())


def brute_revisions(rows):
    held = {}
    for i, t, *_ in rows:
        if i is not None:
            held.setdefault(i, []).append(t)
    return sorted((i, len(ts), len({t for t in ts if t is not None})) for i, ts in held.items() if len(ts) > 1)


def test_record_audit_takes_only_what_is_new(spark, tmp_path):
    records, out, check = (f"{tmp_path}/{n}" for n in ("records", "out", "check"))
    config = json.loads(record_audit.CONFIG.read_text()) | {"files_per_batch": 2}
    first = documents(range(1, 90)) + documents([3, 3, 4])
    spark.createDataFrame(first, DOCS).repartition(5).write.parquet(records)
    tables = record_audit.run(spark, records, out, check, config)
    assert ledger_of(tables) == brute_ledger(first)
    assert tables.read("ledger").select("batch").distinct().count() == 3
    before, had = files_below(f"{out}/ledger"), rows_of({n: tables.read(n) for n in tables.schemas})
    record_audit.run(spark, records, out, check, config)
    assert files_below(f"{out}/ledger") == before and rows_of({n: tables.read(n) for n in tables.schemas}) == had
    more = documents(range(60, 120), end=" revised") + documents([3])
    spark.createDataFrame(more, DOCS).coalesce(1).write.mode("append").parquet(records)
    tables = record_audit.run(spark, records, out, check, config)
    assert ledger_of(tables) == brute_ledger(first + more)
    assert before.items() <= files_below(f"{out}/ledger").items()
    assert sorted(tuple(r) for r in record_audit.latest(tables).collect()) == brute_revisions(first + more)
    whole = record_audit.run(spark, records, f"{out}-whole", f"{check}-whole", config | {"files_per_batch": 100})
    assert cells_of(whole) == cells_of(tables) and sorted(tuple(r) for r in record_audit.latest(whole).collect()) == brute_revisions(first + more)
    assert {c.split(", ")[-1] for c in cells_of(tables)} <= {"'TRUSTED')", "'SUSPICIOUS')", "'UNKNOWN')"}


def test_record_audit_takes_a_batch_again(spark, tmp_path):
    """A batch that was broken off after any of its tables gives the same when it is taken again."""
    records, out, check = (f"{tmp_path}/{n}" for n in ("records", "out", "check"))
    config = json.loads(record_audit.CONFIG.read_text())
    given = documents(range(1, 50)) + documents([5, 5])
    spark.createDataFrame(given, DOCS).write.parquet(records)
    tables = record_audit.run(spark, records, out, check, config)
    had = rows_of({n: tables.read(n) for n in tables.schemas})
    record_audit.take(tables, spark.read.parquet(records), 0, config)
    assert rows_of({n: tables.read(n) for n in tables.schemas}) == had


def test_record_audit_of_nothing(spark, tmp_path):
    records, out, check = (f"{tmp_path}/{n}" for n in ("records", "out", "check"))
    spark.createDataFrame([], DOCS).write.parquet(records)
    config = json.loads(record_audit.CONFIG.read_text())
    tables = record_audit.run(spark, records, out, check, config)
    assert all(tables.read(n).count() == 0 for n in tables.schemas)


@pytest.mark.parametrize("job", ["trust_map", "record_audit"])
def test_command_lines(spark, tmp_path, job):
    table, out = f"{tmp_path}/table", f"{tmp_path}/out"
    if job == "trust_map":
        spark.createDataFrame(lines(), LINES).write.parquet(table)
        args = ["--table", table, "--out", out]
    else:
        spark.createDataFrame(documents(range(20)), DOCS).write.parquet(table)
        args = ["--records", table, "--out", out, "--checkpoint", f"{tmp_path}/check"]
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert f"jobs.{job} read {table}" in done.stderr and "wrote" in done.stderr
    assert spark.read.parquet(f"{out}/cells").count() > 0
