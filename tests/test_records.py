"""Record files, results, journals, reachability and audits."""

import json
import math

import pytest

from plumbline.lang.model import compile_model
from plumbline.operators.atlas import Policy
from plumbline.plans import reach
from plumbline.sources import records
from plumbline.sources.corpus import Region, Truth

MAGIC = b"TEST1\0"
ROWS = [(0, [1.0, -0.0], [math.nan], [[1.0, math.inf], []], 3, 7), (5, [2.0, 3.0], [4.0], [[], [9.0]], 0, 2)]


def test_observation_files(spark, tmp_path):
    data = records.encode(ROWS, MAGIC)
    back = list(records.decode(data, MAGIC))
    assert str(back) == str(ROWS) and str(list(records.decode(records.encode([], MAGIC), MAGIC))) == "[]"
    padded, summed = data[:46] + b"\x01" + data[47:], data[:20] + b"\x63" + data[21:]
    for wrong in (b"OTHER\0" + data[6:], data[:-1], data + b"x", padded, summed):
        with pytest.raises(records.RecordError):
            list(records.decode(wrong, MAGIC))
    (tmp_path / "a.bin").write_bytes(data)
    got = records.read_observations(spark, str(tmp_path / "*.bin"), MAGIC).orderBy("id").collect()
    assert [r.id for r in got] == [0, 5] and math.isnan(got[0].y[0]) and got[0].traces == [[1.0, math.inf], []]


def test_results_and_identity(spark, tmp_path):
    doc = {"sweeps": [{"entry": "a", "outcomes": [{"entry": "a", "budget": 40}, {"entry": "a", "budget": 80}]}, {"entry": "b", "outcomes": []}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    assert sorted(r.budget for r in records.read_results(spark, str(tmp_path / "r.json")).collect()) == [40, 80]
    a = records.identity("s", {"seeds": [2, 1], "budget": 3}, [{"e": 1}, {"e": 0}])
    assert a == records.identity("s", {"seeds": [1, 2], "budget": 3}, [{"e": 0}, {"e": 1}]) != records.identity("s", {"seeds": [1], "budget": 3}, [])
    assert len(a) == 12


def test_journal(spark):
    lines: list[str] = []
    for k in range(5):
        records.append(lines, "note", {"k": k}, "2024-01-01T00:00:00Z")
    rows = [("good", k, x) for k, x in enumerate(lines)] + [("bad", k, x.replace('"k":2', '"k":7')) for k, x in enumerate(lines)]
    got = records.broken_links(spark.createDataFrame(rows, "journal string, nr long, line string")).collect()
    assert [tuple(r) for r in got] == [("bad", 3)]


def test_reach_and_crossings():
    m = compile_model("model m { input a in [0, 1] input b in [0, 1] let y = a require y <= 0.3 }")
    policy = Policy(max_depth=8)
    kinds = {
        "enclosed": Region({"a": (0.3, 1.0)}), "sub-granular": Region({"a": (0.5, 0.5001)}), "unreachable": Region({"a": (2.0, 3.0)}), "carved-away": Region({"a": (0.0, 1.0)}, "a > 2"),
    }
    for kind, r in kinds.items():
        assert reach.reach(m, Truth([r], []), policy)[0] == kind
    assert reach.reach(m, Truth([], []))[0] == "no-region" and reach.reach(None, Truth([], []))[0] == "no-model" and reach.reach(m, Truth([kinds["enclosed"]], []), Policy(max_depth=20))[0] == "uncappable"
    assert reach.crossings(m, 0) == [pytest.approx(0.3, abs=1e-5)] and reach.crossings(m, 1) == [0.5][:0]


def test_audit(spark):
    m = compile_model("model m { input a in [0, 1] }")
    bad = Truth([Region({"z": (0, 1)}), Region({"a": (1, 1)}), Region({"a": (5, 6)}), Region({"a": (5, 6)})], [{"axis": "a", "at": 3, "tolerance": 0.1}, {"axis": "q", "at": 0, "tolerance": 1}], control=True)
    assert len(list(reach.problems("e", m, bad))) == 8 and not list(reach.problems("e", m, Truth([Region({"a": (0, 0.5)})], [])))
    entries = spark.createDataFrame([("x/a", 'model a "one" { input x in [0, 1] }'), ("x/b", "model b {  input x in [0,  1] }"), ("x/c", "model c { input y in [0, 1] }")], "entry string, model string")
    assert [tuple(r) for r in reach.duplicate_models(entries).collect()] == [("x/b", "x/a")]
