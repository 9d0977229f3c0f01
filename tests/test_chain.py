"""Journals that arrive out of order, as a stream."""

import datetime
import hashlib
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from plumbline.streaming import chain

LINES = "journal string, nr long, at timestamp, line string"
START = datetime.datetime(2024, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def told(spark, folder, batches, patience, forget, late):
    """What is told after each batch, batches being taken one by one from files that come one after the other."""
    out = []
    with chain.provider(spark):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/lines")
            stream = spark.readStream.schema(LINES).parquet(f"{folder}/lines")
            made = chain.chained(stream, datetime.timedelta(minutes=patience), datetime.timedelta(minutes=forget), late)
            made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
            rows = spark.read.parquet(f"{folder}/out").collect()
            out.append(sorted((r.journal, r.nr, r.status, r.digest) for r in rows))
    return out


def test_chains_of_lines_out_of_order(spark, tmp_path):
    lines = {nr: f"line {nr}" for nr in range(1, 9)}
    row = lambda nr, journal="a", text=None: (journal, nr, at(nr), text or lines[nr])
    first, second = [row(2), row(5), row(1, "b"), (None, 1, at(0), "x"), ("a", None, at(0), "x")], [row(3), row(1), row(4), row(2)]
    after = told(spark, str(tmp_path), [first, second], 1000, 1000, "1 hour")
    digest, want = chain.ZERO, []
    for nr in range(1, 6):
        digest = hashlib.sha256(f"{digest}\n{lines[nr]}".encode()).hexdigest()
        want.append(("a", nr, "linked", digest))
    b = ("b", 1, "linked", hashlib.sha256(f"{chain.ZERO}\n{lines[1]}".encode()).hexdigest())
    assert after[0] == [b]
    assert after[1] == sorted([*want, b, ("a", 2, "late", None)], key=lambda r: r[:3])


def test_gaps_and_ends(spark, tmp_path):
    """A line that does not come is a gap once its time is up; a silent journal is closed and forgotten."""
    row = lambda journal, nr, minute: (journal, nr, at(minute), f"{journal}{nr}")
    batches = [[row("a", 1, 0), row("a", 3, 1), row("b", 1, 0)], [row("c", 1, 30)], [row("a", 2, 40), row("c", 2, 200)]]
    after = told(spark, str(tmp_path), batches, 10, 60, "0 seconds")
    first = chain.link(chain.ZERO, "a1")
    assert [r[:3] for r in after[0]] == [("a", 1, "linked"), ("b", 1, "linked")]
    assert ("a", 2, "gap", None) in after[1] and ("a", 3, "linked", chain.link(first, "a3")) in after[1]
    assert ("a", 2, "late", None) in after[2]
    assert {r[:3] for r in after[2]} >= {("b", 1, "closed"), ("c", 2, "linked")}


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    with chain.provider(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


class Held:
    """A journal's state in memory, which counts what is put into it."""

    def __init__(self):
        self.value, self.map, self.puts, self.timers = None, {}, 0, []

    getValueState = getMapState = lambda self, *_: self
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = lambda self, v: setattr(self, "value", v)
    containsKey = lambda self, k: k in self.map
    getValue = lambda self, k: self.map[k]
    removeKey = lambda self, k: self.map.pop(k)
    keys = lambda self: list(self.map)
    values = lambda self: list(self.map.values())
    listTimers = lambda self: self.timers
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)

    def updateValue(self, k, v):
        self.map[k], self.puts = v, self.puts + 1


def test_lines_that_have_their_turn_do_not_wait(monkeypatch):
    row = lambda nr, text=None: {"nr": nr, "line": text or f"l{nr}", "at_ms": nr}
    batches = [[row(k) for k in (3, 1, 2, 3, 9, 8)], [row(k) for k in (5, 4, 8, 6, 1)], [row(7), row(10)]]
    for most, puts in ((10_000, 3), (2, None)):
        monkeypatch.setattr(chain, "AT_ONCE", most, raising=False)
        state, journal = Held(), chain.LineChain(100, 1000)
        journal.init(state)
        out = [[(r.nr, r.status, r.digest) for r in journal.handleInputRows(("a",), iter(b), None)] for b in batches]
        digest, want = chain.ZERO, {}
        for nr in range(1, 11):
            digest = chain.link(digest, f"l{nr}")
            want[nr] = (nr, "linked", digest)
        assert out == [[(3, "late", None), want[1], want[2], want[3]], [(8, "late", None), (1, "late", None), want[4], want[5], want[6]], [want[7], want[8], want[9], want[10]]]
        assert not state.map and state.timers == [10 + 1000]
        assert puts is None or state.puts == puts  # 8 and 9 wait, and 8 comes twice


class Plain:
    """One journal by the definition, without parts."""

    def __init__(self, patience, forget):
        self.patience, self.forget, self.known = patience, forget, False
        self.nr, self.digest, self.seen, self.waiting = 0, chain.ZERO, 0, {}

    def linked(self):
        while self.nr + 1 in self.waiting:
            self.nr += 1
            self.digest = chain.link(self.digest, self.waiting.pop(self.nr)[0])
            yield self.nr, "linked", self.digest

    def came(self, rows):
        self.known = True
        for r in rows:
            self.seen = max(self.seen, r["at_ms"] or 0)
            if r["nr"] <= self.nr or r["nr"] in self.waiting:
                yield r["nr"], "late", None
            if r["nr"] > self.nr:
                self.waiting.setdefault(r["nr"], []).append((r["line"], r["at_ms"]))
        for nr, held in self.waiting.items():
            if isinstance(held, list):
                times = [t for _, t in held if t is not None]
                self.waiting[nr] = (min(line for line, _ in held), min(times, default=None))
        yield from self.linked()
        self.waiting = {nr: [v] for nr, v in self.waiting.items()}

    def passed(self, now):
        self.waiting = {nr: v[0] for nr, v in self.waiting.items()}
        while self.known:
            times = [t for _, t in self.waiting.values() if t is not None]
            if not self.waiting and self.seen + self.forget <= now:
                yield self.nr, "closed", self.digest
                self.__init__(self.patience, self.forget)
            elif times and min(times) + self.patience <= now:
                self.nr = min(self.waiting) - 1
                yield self.nr, "gap", None
                yield from self.linked()
            else:
                break
        self.waiting = {nr: [v] for nr, v in self.waiting.items()}


class Fired:
    def __init__(self, at_ms):
        self.at_ms = at_ms

    def getExpiryTimeInMs(self):
        return self.at_ms


def test_parts_tell_what_the_definition_tells(monkeypatch):
    seen = set()
    for seed in range(120):
        draw = random.Random(seed)
        for name, least, most in (("AT_ONCE", 2, 12), ("PART", 1, 6), ("PART_CHARS", 1, 40), ("FEW", 0, 3), ("OPEN", 1, 3)):
            monkeypatch.setattr(chain, name, draw.randint(least, most))
        state, journal, plain = Held(), chain.LineChain(100, 1000), Plain(100, 1000)
        state.clear = lambda s=state: setattr(s, "value", None)
        journal.init(state)
        for step in range(draw.randint(1, 8)):
            rows = [{"nr": draw.randint(1, 30), "line": draw.choice("abc") * draw.randint(0, 9), "at_ms": draw.choice([None, *[20 * step + 10 * k for k in range(1, 9)]])} for _ in range(draw.randint(1, 20))]
            now = 20 * step + draw.choice([5, 95, 1205])
            out, want = [(r.nr, r.status, r.digest) for r in journal.handleInputRows(("a",), iter(rows), None)], list(plain.came(rows))
            while state.timers and min(state.timers) <= now:
                t = min(state.timers)
                out += [(r.nr, r.status, r.digest) for r in journal.handleExpiredTimer(("a",), None, Fired(t))]
                state.timers = [x for x in state.timers if x != t]
            assert out == want + list(plain.passed(now)), (seed, step)
            assert len(state.timers) <= 1
            seen |= {status for _, status, _ in out}
    assert seen == {"linked", "late", "gap", "closed"}


def test_lines_that_wait_are_put_and_told_together():
    """A call to the state, or a row to or from Python, for each line is what made long streams slow."""
    state, journal = Held(), chain.BundleChain(100, 1000)
    journal.init(state)
    frame = lambda nrs: pd.DataFrame([("a", nr, nr * 1000 if nr % 7 else chain.UNTIMED, f"l{nr}") for nr in nrs], columns=["journal", "nr", "us", "line"])
    odd, even = list(range(601, 0, -2)), list(range(600, 0, -2))
    out = []
    for batch in (even[:200], odd[:200], even[200:] + odd[200:]):
        bundles = pd.concat(chain.bundled(iter([frame(batch[:50]), frame(batch[50:])])))
        assert len(bundles) <= 3 and set(bundles.journal) == {"a"}
        out.append(list(journal.handleInputRows(("a",), iter(bundles.to_dict("records")), None)))
    assert not out[0] and not out[1] and len(out[2]) <= 3 and state.puts <= 4 and not state.map
    digest, want = chain.ZERO, []
    for nr in range(1, 602):
        digest = chain.link(digest, f"l{nr}")
        want.append((nr, digest))
    assert [(r.nr + k, d) for r in out[2] for k, d in enumerate(r.digests)] == want and {r.status for r in out[2]} == {"linked"}


def test_lines_without_a_time_have_their_own_bundles():
    rows = [("a", 1, 5000, "x"), ("b", 1, 1000, "é\n\""), ("a", 2, chain.UNTIMED, ""), ("a", 3, 9999, "z")]
    made = pd.concat(chain.bundled(iter([pd.DataFrame(rows, columns=["journal", "nr", "us", "line"])])))
    assert sorted((j, us, json.loads(lines)) for j, us, lines in made.itertuples(index=False)) == [("a", chain.UNTIMED, [[2, "", None]]), ("a", 9999, [[1, "x", 5], [3, "z", 9]]), ("b", 1000, [[1, "é\n\"", 1]])]
    assert list(chain.bundled(iter([]))) == []


def test_a_hot_journal_and_lines_without_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chain, "AT_ONCE", 100)
    nrs = list(range(1, 1201))
    random.Random(3).shuffle(nrs)
    row = lambda nr: ("hot", nr, None if nr % 5 == 0 else at(nr % 50), f"line {nr}")
    after = told(spark, str(tmp_path), [[row(nr) for nr in nrs[:600]], [row(nr) for nr in [*nrs[600:], nrs[0]]]], 1000, 100_000, "1 hour")
    digest, want = chain.ZERO, [("hot", nrs[0], "late", None)]
    for nr in range(1, 1201):
        digest = chain.link(digest, f"line {nr}")
        want.append(("hot", nr, "linked", digest))
    assert sorted(after[1], key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
