"""Frozen experiments: protocol files of versions 1 to 4, their arms, and the campaigns that an arm consists of."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from plumbline.lang.model import Model
from plumbline.operators.atlas import Policy
from plumbline.operators.evidence import CHANNELS
from plumbline.plans.campaign import Config, plan

VERSIONS = ("1", "2", "3", "4")
#: The names of rates in a plan, and the fields of a configuration that they set.
RATES = {name: name for name in ("probe_every", "numerical_every", "differential_every", "symmetric_every", "refine_every", "calibrate_every")}
BARS = ("certify_share", "certify_density")
#: What an arm may move beside the channels it silences; certify is new in version 4, resolution in 3, trust in 2.
AXES = {"trust": "2", "resolution": "3", "certify": "4"}


class ProtocolError(ValueError):
    pass


@dataclass(frozen=True)
class Arm:
    name: str
    silenced: tuple[str, ...]
    policy: Policy


@dataclass(frozen=True)
class Protocol:
    id: str
    version: str
    digest: str
    strategies: tuple[str, ...]
    seeds: tuple[int, ...]
    budgets: tuple[int, ...]
    config: Config
    arms: tuple[Arm, ...]
    entries: tuple[str, ...]

    @staticmethod
    def read(text: str) -> Protocol:
        d = json.loads(text)
        family, _, version = str(d.get("schema", "")).rpartition("/")
        if not family.endswith("protocol") or version not in VERSIONS:
            raise ProtocolError(f"unknown schema {d.get('schema')!r}")
        for name in ("id", "plan", "arms", "entries"):
            if name not in d:
                raise ProtocolError(f"no {name}")
        rates = {field: d["plan"][name] for name, field in RATES.items() if name in d["plan"]}
        bars = {name: d["plan"][name] for name in BARS if name in d["plan"]}
        arms = []
        for a in d["arms"]:
            if wrong := set(a.get("ablate", [])) - {c.lower() for c in CHANNELS} - set(CHANNELS):
                raise ProtocolError(f"arm {a['name']}: no channel {sorted(wrong)}")
            if early := [axis for axis, since in AXES.items() if axis in a and version < since]:
                raise ProtocolError(f"arm {a['name']}: {', '.join(early)} is not of version {version}")
            silenced = tuple(c for c in CHANNELS if c in a.get("ablate", []) or c.lower() in a.get("ablate", []))
            arms.append(Arm(a["name"], silenced, Policy(**bars, **{axis: a[axis] for axis in AXES if axis in a})))
        if len({a.name for a in arms}) < len(arms):
            raise ProtocolError("two arms of one name")
        entries = d["entries"]["run"] if isinstance(d["entries"], dict) else d["entries"]
        return Protocol(d["id"], version, hashlib.sha256(text.encode()).hexdigest()[:16], tuple(d["plan"]["strategies"]), tuple(d["plan"]["seeds"]), tuple(d["plan"]["budgets"]), replace(Config(), **rates), tuple(arms), tuple(entries))

    def arm(self, name: str) -> Arm:
        """An arm by its name; none is taken by default."""
        for a in self.arms:
            if a.name == name:
                return a
        raise ProtocolError(f"{self.id} has no arm {name!r}, but {', '.join(a.name for a in self.arms)}")

    def campaigns(self, name: str, models: Mapping[str, Model]) -> list[tuple[str, str, str]]:
        """(campaign, model text, config) of one arm over its entries, as plan() has them."""
        if missing := [e for e in self.entries if e not in models]:
            raise ProtocolError(f"no model for {', '.join(missing)}")
        arm = self.arm(name)
        return plan({e: models[e] for e in self.entries}, self.strategies, self.seeds, self.budgets, replace(self.config, silenced=arm.silenced, policy=arm.policy))

    def remaining(self, name: str, models: Mapping[str, Model], done: DataFrame) -> list[tuple[str, str, str]]:
        """Those of campaigns() that no row of done (campaign) has: what is left of an arm that was broken off."""
        have = {r[0] for r in done.select("campaign").distinct().toLocalIterator()}
        return [c for c in self.campaigns(name, models) if c[0] not in have]


ARMS = "protocol string, version string, digest string, arm string, silenced array<string>, trust string, resolution string, certify string, strategies array<string>, seeds array<long>, budgets array<long>, entries array<string>"


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    """A row for each arm of the protocol files at path."""
    rows = []
    for r in spark.read.option("wholetext", True).text(path).toLocalIterator():
        p = Protocol.read(r[0])
        rows += [(p.id, p.version, p.digest, a.name, list(a.silenced), a.policy.trust, a.policy.resolution, a.policy.certify, list(p.strategies), list(p.seeds), list(p.budgets), list(p.entries)) for a in p.arms]
    return spark.createDataFrame(rows, ARMS)
