"""The command line over a small corpus."""

import json

from plumbline import cli

RAMP = "model ramp { input a in [0, 1] let s = a * 2 require s < 1 }"
TRUTH = {"schema": "x/1", "regions": [{"axes": {"a": [0.5, 1.0]}}], "boundaries": [{"axis": "a", "at": 0.5, "tolerance": 0.05}]}


def corpus_at(root, entries):
    for name, (model, truth) in entries.items():
        folder = root / "family" / name
        folder.mkdir(parents=True)
        (folder / "model.ap").write_text(model)
        (folder / "truth.json").write_text(json.dumps(truth))
    return str(root)


def test_bench_reads_a_corpus(spark, tmp_path, capsys):
    root = corpus_at(tmp_path / "c", {"ramp": (RAMP, TRUTH)})
    said = lambda *argv: (cli.main(["bench", *argv]), capsys.readouterr().out)
    assert said("list", root) == (0, "family/ramp\tfaulty\t1 inputs\t1 regions\t1 boundaries\n")
    assert said("audit", root) == (0, "") and said("verify", root)[0] == 0
    assert said("reach", root)[1].startswith("family/ramp\tenclosed\t")
    name, crossed = said("scan", root, "family/ramp")[1].strip().split("\t")
    assert name == "a" and len(at := json.loads(crossed)) == 1 and abs(at[0] - 0.5) < 1e-3
    code, text = said("explain", root, "family/ramp", "--budget", "80")
    assert code == 0 and json.loads(text)["outcome"]["declared_regions"] == 1
    assert said("scan", root, "family/none")[0] == 2


def test_bench_audit_tells_faults(spark, tmp_path, capsys):
    wrong = TRUTH | {"boundaries": [{"axis": "z", "at": 0.5, "tolerance": 0.05}]}
    root = corpus_at(tmp_path / "c", {"ramp": (RAMP, TRUTH), "twin": (RAMP.replace("ramp", "twin"), wrong)})
    assert cli.main(["bench", "audit", root]) == 1
    out = capsys.readouterr().out
    assert "a boundary is on 'z'" in out and "the same model as family/ramp" in out


def test_bench_arms(spark, tmp_path, capsys):
    root = corpus_at(tmp_path / "c", {"ramp": (RAMP, TRUTH)})
    p = {"schema": "x.protocol/4", "id": "p", "plan": {"strategies": ["adaptive", "random"], "seeds": [1], "budgets": [40, 80]}, "arms": [{"name": "full"}, {"name": "quiet", "ablate": ["Physical"]}], "entries": ["family/ramp"]}
    (tmp_path / "p.json").write_text(json.dumps(p))
    run = lambda out, *more: cli.main(["bench", "run", root, "--out", str(tmp_path / out), *more])
    for arm in ("full", "quiet"):
        assert run(arm, "--protocol", str(tmp_path / "p.json"), "--arm", arm) == 0
    assert run("other", "--strategies", "adaptive", "random", "--seeds", "1", "--budgets", "40", "90") == 0
    capsys.readouterr()
    assert cli.main(["bench", "verdict", str(tmp_path / "full")]) == 0 and "family/ramp" in capsys.readouterr().out
    assert cli.main(["bench", "e2", str(tmp_path / "full"), str(tmp_path / "quiet")]) == 0
    assert cli.main(["bench", "e2", str(tmp_path / "full"), str(tmp_path / "other")]) == 1
    assert "no partner for family/ramp/adaptive/1/90" in capsys.readouterr().out
