"""python -m plumbline.cli run|replay|report|compare|bench ...: a thin shell over the library.

Exit codes: 0 done, 1 suspicious regions found (run), a difference (replay, compare), a fault in a corpus (bench verify,
audit) or a refused comparison (bench e2), 2 a model, entry or archive that cannot be read.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.lang.model import Model, compile_model
from plumbline.lang.syntax import ModelError
from plumbline.operators import compare, metrics
from plumbline.plans.campaign import Campaign, Config, plan
from plumbline.plans.reach import crossings, duplicate_models, problems, reach
from plumbline.sources import archive, corpus
from plumbline.sources.protocol import AXES, Protocol


def session() -> SparkSession:
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def run(a: argparse.Namespace) -> int:
    spark = session()
    try:
        model = compile_model(text_of(spark, a.model))
    except ModelError as e:
        print(e, file=sys.stderr)
        return 2
    c = Campaign(model, Config(a.strategy, a.seed, a.budget)).run()
    print(json.dumps({"model": model.name, "evaluations": c.evaluations, "coverage": c.space.shares(), "bands": c.space.edges(), "findings": c.findings}, indent=1))
    if a.out:
        archive.write(spark, c, a.out)
    return 1 if c.findings else 0


def replay(a: argparse.Namespace) -> int:
    kept = archive.Archive(session(), a.archive)
    damaged, differing = kept.damaged(), kept.replay().count()
    print(json.dumps({"damaged": damaged, "differing": differing}))
    return 1 if damaged or differing else 0


def report(a: argparse.Namespace) -> int:
    kept = archive.Archive(session(), a.archive)
    print(json.dumps({k: kept.manifest[k] for k in ("model", "config", "counts", "coverage")}, indent=1))
    kept.tables["findings"].orderBy("final_risk", ascending=False).show(20, truncate=60)
    return 0


def compare_two(a: argparse.Namespace) -> int:
    spark = session()
    both = archive.compared(spark, archive.Archive(spark, a.first), archive.Archive(spark, a.second))
    compare.tally(both, ["section"]).orderBy("section").show()
    said = compare.verdict(both).first()[0]
    print(said)
    return 0 if said == "identical" else 1


def entries(spark: SparkSession, root: str) -> Iterator[tuple[str, str, str, Model | None, corpus.Truth]]:
    """(entry, model text, truth text, model, truth) of a corpus; no model where it is refused."""
    for r in corpus.registry(spark, root).orderBy("entry").toLocalIterator():
        try:
            model = compile_model(r["model"])
        except ModelError:
            model = None
        yield r["entry"], r["model"], r["truth"], model, corpus.Truth.read(r["truth"])


def outcomes_at(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/outcomes")


def show_verdict(outcomes: DataFrame) -> None:
    said = metrics.verdict(metrics.ladder(outcomes)).persist()
    said.orderBy("entry", "seed").show(1000, truncate=False)
    said.groupBy("verdict").count().orderBy("verdict").show()
    said.unpersist()


def bench_run(a: argparse.Namespace) -> int:
    """Campaigns over a corpus, or one arm of a protocol; --out keeps outcomes and plan for verdict and e2."""
    spark = session()
    strategies, seeds, budgets, config, wanted = a.strategies, a.seeds, a.budgets, Config(), None
    if a.protocol:
        p = Protocol.read(text_of(spark, a.protocol))
        arm = p.arm(a.arm)
        strategies, seeds, budgets, wanted = p.strategies, p.seeds, p.budgets, set(p.entries)
        config = replace(p.config, silenced=arm.silenced, policy=arm.policy)
    rows = []
    for entry, _, truth, model, told in entries(spark, a.corpus):
        if wanted is not None and entry not in wanted:
            continue
        if model is None:
            print(f"{entry}: refused")
        elif not told.static:
            rows += [(entry, text, truth, c) for _, text, c in plan({entry: model}, strategies, seeds, budgets, config)]
    if wanted is not None and (missing := wanted - {r[0] for r in rows}):
        print(f"no model for {', '.join(sorted(missing))}", file=sys.stderr)
        return 2
    if not rows:
        print("nothing to run", file=sys.stderr)
        return 2
    jobs = spark.createDataFrame(rows, "entry string, model string, truth string, config string").repartition(max(1, len(rows) // 4))
    outcomes = corpus.sweep(jobs)
    if a.out:
        outcomes.write.parquet(f"{a.out}/outcomes")
        outcomes = outcomes_at(spark, a.out)
        # What an arm may not change: all but the channels it silences and its policy's axes.
        same = {k: v for k, v in asdict(config).items() if k not in ("strategy", "seed", "budget", "silenced", "policy")}
        same |= {k: v for k, v in asdict(config.policy).items() if k not in AXES} | {"strategies": list(strategies), "seeds": list(seeds), "budgets": list(budgets)}
        spark.createDataFrame([(k, json.dumps(v)) for k, v in same.items()], "field string, value string").write.parquet(f"{a.out}/plan")
    else:
        outcomes = outcomes.persist()
    outcomes.orderBy("entry", "strategy", "seed", "budget").show(1000, truncate=False)
    show_verdict(outcomes)
    return 0


def bench_verdict(a: argparse.Namespace) -> int:
    show_verdict(outcomes_at(session(), a.outcomes))
    return 0


def bench_e2(a: argparse.Namespace) -> int:
    """The full arm against another, both as bench run left them; 1 where the comparison is refused."""
    spark = session()
    plans = spark.read.parquet(f"{a.full}/plan").withColumnRenamed("value", "full").join(spark.read.parquet(f"{a.arm}/plan").withColumnRenamed("value", "arm"), "field", "full")
    control = F.col("declared_regions") == 0
    localised = ~control & (F.col("localised_regions") == F.col("declared_regions"))
    sides = [outcomes_at(spark, folder).withColumns({"control": control, "localised": localised}) for folder in (a.full, a.arm)]
    rows = metrics.ablation_pairs(*sides, plans).persist()
    rows.groupBy("status").agg(F.count("*").alias("rows"), F.avg("control_delta").alias("control_delta")).orderBy("status").show()
    refused = rows.where("status = 'refused'").first()
    if refused:
        print(refused.reason)
    return 1 if refused else 0


def bench_list(a: argparse.Namespace) -> int:
    for entry, _, _, model, t in entries(session(), a.corpus):
        kind = "control" if t.control else "static" if t.static else "faulty"
        print(entry, kind, f"{len(model.params)} inputs" if model else "refused", f"{len(t.regions)} regions", f"{len(t.boundaries)} boundaries", sep="\t")
    return 0


def bench_verify(a: argparse.Namespace) -> int:
    bad = 0
    for entry, _, _, model, t in entries(session(), a.corpus):
        if model is not None and not t.static:
            said = corpus.verify(model, t)
            bad += not said["good"]
            print(entry, json.dumps(said), sep="\t")
    return 1 if bad else 0


def bench_audit(a: argparse.Namespace) -> int:
    spark = session()
    found = [w for entry, _, _, model, t in entries(spark, a.corpus) for w in problems(entry, model, t)]
    found += [(r["entry"], f"the same model as {r['of']}") for r in duplicate_models(corpus.registry(spark, a.corpus)).orderBy("entry").toLocalIterator()]
    for entry, what in found:
        print(entry, what, sep="\t")
    return 1 if found else 0


def bench_reach(a: argparse.Namespace) -> int:
    for entry, _, _, model, t in entries(session(), a.corpus):
        kind, each = reach(model, t)
        print(entry, kind, json.dumps([asdict(e) for e in each]), sep="\t")
    return 0


def one_entry(spark: SparkSession, a: argparse.Namespace) -> tuple[Model, corpus.Truth] | None:
    for entry, _, _, model, t in entries(spark, a.corpus):
        if entry == a.entry and model is not None:
            return model, t
    print(f"no model for {a.entry}", file=sys.stderr)
    return None


def bench_scan(a: argparse.Namespace) -> int:
    """Where rules change sides along each input, the others in the middle."""
    if (got := one_entry(session(), a)) is None:
        return 2
    for k, axis in enumerate(got[0].params):
        print(axis.name, json.dumps([] if axis.discrete else crossings(got[0], k)), sep="\t")
    return 0


def bench_explain(a: argparse.Namespace) -> int:
    """One campaign on an entry: what was declared, and what was found of it."""
    if (got := one_entry(session(), a)) is None:
        return 2
    c = Campaign(got[0], Config(a.strategy, a.seed, a.budget)).run()
    declared = [{"axes": r.axes, "where": r.where, "reason": r.reason} for r in got[1].regions]
    print(json.dumps({"declared": declared, "boundaries": got[1].boundaries, "outcome": corpus.outcome(a.entry, c, got[1]), "bands": c.space.edges(), "findings": c.findings}, indent=1))
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(required=True)
    s = sub.add_parser("run")
    s.add_argument("model"), s.add_argument("--strategy", default="adaptive"), s.add_argument("--seed", type=int, default=0), s.add_argument("--budget", type=int, default=640), s.add_argument("--out")
    s.set_defaults(do=run)
    for name, do, args in (("replay", replay, ["archive"]), ("report", report, ["archive"]), ("compare", compare_two, ["first", "second"])):
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        s.set_defaults(do=do)
    of = sub.add_parser("bench").add_subparsers(required=True)
    for name, do, args in (
        ("list", bench_list, ["corpus"]), ("verify", bench_verify, ["corpus"]), ("audit", bench_audit, ["corpus"]), ("reach", bench_reach, ["corpus"]), ("run", bench_run, ["corpus"]),
        ("verdict", bench_verdict, ["outcomes"]), ("scan", bench_scan, ["corpus", "entry"]), ("explain", bench_explain, ["corpus", "entry"]), ("e2", bench_e2, ["full", "arm"]),
    ):
        s = of.add_parser(name)
        for x in args:
            s.add_argument(x)
        s.set_defaults(do=do)
        if name == "run":
            s.add_argument("--strategies", nargs="+", default=["adaptive", "random", "stratified"]), s.add_argument("--seeds", nargs="+", type=int, default=[1, 2, 3]), s.add_argument("--budgets", nargs="+", type=int, default=[60, 120, 250, 500, 1000])
            s.add_argument("--protocol"), s.add_argument("--arm"), s.add_argument("--out")
        if name == "explain":
            s.add_argument("--strategy", default="adaptive"), s.add_argument("--seed", type=int, default=0), s.add_argument("--budget", type=int, default=640)
    a = p.parse_args(argv)
    return a.do(a)


if __name__ == "__main__":
    sys.exit(main())
