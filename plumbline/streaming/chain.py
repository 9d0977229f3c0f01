"""Journals whose lines arrive out of order, chained by digest as they become complete.

A line has its journal, its number (from 1) and the time it was written. A journal's chain holds for each line the digest
of the chain before it and the line; it can go on only with the next number, so lines that come early wait. Rows tell:

* ``linked``: the line has its place in the chain, and digest is the chain's up to it;
* ``gap``: lines up to nr did not come within ``patience`` of event time after a later line was written; the chain goes on
  behind them from the digest it had;
* ``late``: a line that the chain is past, as it came twice or after its gap was told;
* ``closed``: nothing came for ``forget`` of event time after the last line; the journal's state goes, so state does not
  grow with journals that have ended. A journal that goes on after that begins anew, with a gap.

A call to the state, and a row to or from Python, costs far more than a line, so lines come to the state in bundles of one
journal (``bundled``) and what is told leaves it in runs. A bundle all of whose lines are late by more than the stream's
watermark allows is dropped by Spark before it comes here; a line as late that shares a bundle with a later one is told
like any other. Of several waiting lines with one number the first by text stays. Lines without journal or number are left
out, and lines without a time wait without a limit. The session needs the RocksDB state store (``provider``).
"""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Generator, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, MapState, TimerValues

ZERO = "0" * 64
#: Lines of one journal that a batch holds before they go into the state.
AT_ONCE = 10_000
#: Lines, and characters unless a line alone has more, that are put and read as one text; so few lines are put one by one.
PART, PART_CHARS, FEW = 256, 65_536, 2
#: Parts that are held for lines that come again.
OPEN = 64
#: By number, a line and when it was written.
Lines = dict[int, tuple[str, int | None]]
#: Number, digest and status.
Told = tuple[int, str | None, str]
#: Lines, and characters, of a task that are sorted into bundles at once.
BUNDLED, BUNDLED_CHARS = 200_000, 1 << 25
#: The time, in microseconds, of a line without one.
UNTIMED = -(1 << 63)
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def provider(spark: SparkSession) -> Iterator[None]:
    """The state store that the chains need, for streams that are started inside."""
    key, value = _PROVIDER
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def link(digest: str, line: str) -> str:
    return hashlib.sha256(f"{digest}\n{line}".encode()).hexdigest()


def first(one: tuple[str, int | None], line: str, at: int | None) -> tuple[str, int | None]:
    """Of two lines with one number the first by text, and the earlier of their times."""
    return min(one[0], line), earliest([one[1], at])


def as_text(some: list) -> str:
    return json.dumps(some, ensure_ascii=False, separators=(",", ":"))


def pack(lines: Lines) -> str:
    return as_text([[nr, *line] for nr, line in sorted(lines.items())])


def unpack(text: str) -> Lines:
    return {nr: (line, at) for nr, line, at in json.loads(text or "[]")}


def earliest(times: Iterable[int | None]) -> int | None:
    return min((t for t in times if t is not None), default=None)


def cut(lines: Lines) -> Iterator[Lines]:
    """lines by their numbers in parts of one text each; few lines each by itself."""
    part: Lines = {}
    size = 0
    for nr in sorted(lines):
        if part and (len(lines) <= FEW or len(part) >= PART or size + len(lines[nr][0]) > PART_CHARS):
            yield part
            part, size = {}, 0
        part[nr] = lines[nr]
        size += len(lines[nr][0])
    if part:
        yield part


class Waiting:
    """A journal's lines that wait: near, the text beside its head, and parts in the state, read when a line of theirs is due.

    A call to the state costs far more than the lines it carries, so lines that come together are put and read together.
    Of a part the first number, under which it was put, the earliest time and the numbers that still wait are kept; its
    text may hold lines that the chain is past.
    """

    def __init__(self, state: MapState, near: str, far: str) -> None:
        self.state = state
        self.near = unpack(near)
        self.parts = {k: (at, set(nrs)) for k, at, nrs in json.loads(far or "[]")}
        self.part_of = {nr: k for k, (_, nrs) in self.parts.items() for nr in nrs}
        self.open: dict[int, Lines] = {}
        self.changed: set[int] = set()

    def __contains__(self, nr: int) -> bool:
        return nr in self.near or nr in self.part_of

    def __bool__(self) -> bool:
        return bool(self.near or self.part_of)

    def least(self) -> int:
        return min(min(nrs) for nrs in (self.near, self.part_of) if nrs)

    def lines(self, k: int) -> Lines:
        """The lines of a part that still wait."""
        if k not in self.open:
            self.open[k] = {nr: line for nr, line in unpack(self.state.getValue((k,))[0]).items() if self.part_of.get(nr) == k}
        return self.open[k]

    def add(self, lines: Lines) -> None:
        """Lines that are not here yet: beside the head while there is room, unless they are few and would have all of it written anew."""
        if FEW < len(lines) <= PART - len(self.near) and sum(len(line) for held in (self.near, lines) for line, _ in held.values()) <= PART_CHARS:
            self.near |= lines
            return
        for part in cut(lines):
            k = min(part)
            self.state.updateValue((k,), (pack(part),))
            self.parts[k] = (earliest(at for _, at in part.values()), set(part))
            self.part_of |= dict.fromkeys(part, k)

    def again(self, nr: int, line: str, at: int | None) -> None:
        """A line whose number waits already."""
        if nr in self.near:
            self.near[nr] = first(self.near[nr], line, at)
            return
        if len(self.open) >= OPEN:
            self.shut()
        k = self.part_of[nr]
        held = self.lines(k)
        held[nr] = first(held[nr], line, at)
        self.changed.add(k)

    def take(self, nr: int) -> str:
        if nr in self.near:
            return self.near.pop(nr)[0]
        k = self.part_of[nr]
        line, _ = self.lines(k).pop(nr)
        del self.part_of[nr]
        self.parts[k][1].remove(nr)
        if not self.parts[k][1]:
            self.state.removeKey((k,))
            del self.parts[k], self.open[k]
            self.changed.discard(k)
        return line

    def shut(self) -> None:
        """Parts that were read are written if their lines are others now, and let go."""
        for k, lines in self.open.items():
            self.parts[k] = (earliest(at for _, at in lines.values()), self.parts[k][1])
            if k in self.changed:
                self.state.updateValue((k,), (pack(lines),))
        self.open.clear()
        self.changed.clear()

    def earliest(self) -> int | None:
        """The earliest time of a line that waits, once parts are shut."""
        return earliest([*(at for _, at in self.near.values()), *(at for at, _ in self.parts.values())])

    def texts(self) -> tuple[str, str]:
        """Near and far, as they are kept with the head."""
        return pack(self.near) if self.near else "", as_text([[k, at, sorted(nrs)] for k, (at, nrs) in self.parts.items()]) if self.parts else ""


class LineChain(StatefulProcessor):
    """One journal: where its chain is, the lines that wait, and one timer for what comes next."""

    def __init__(self, patience_ms: int, forget_ms: int) -> None:
        self.patience, self.forget = patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "nr long, digest string, seen long, due long, near string, far string")
        self.waiting = handle.getMapState("waiting", "nr long", "lines string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        for nr, digest, status in self.came((r["nr"], r["line"], r["at_ms"]) for r in rows):
            yield Row(journal=key[0], nr=nr, digest=digest, status=status)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        for nr, digest, status in self.expired(expiredTimerInfo.getExpiryTimeInMs()):
            yield Row(journal=key[0], nr=nr, digest=digest, status=status)

    def came(self, lines: Iterable[tuple[int, str, int | None]]) -> Iterator[Told]:
        nr, digest, seen, due, near, far = self.head.get() or (0, ZERO, 0, None, "", "")
        held = Waiting(self.waiting, near, far)
        fresh: Lines = {}  # of these lines; what has its turn at once never goes into the state
        for n, line, at in lines:
            seen = max(seen, at or 0)
            if n > nr and n not in fresh and n not in held:
                fresh[n] = (line, at)
                if len(fresh) >= AT_ONCE:
                    held.add(fresh)
                    fresh = {}
                continue
            if n in fresh:
                fresh[n] = first(fresh[n], line, at)
            elif n > nr:
                held.again(n, line, at)
            yield n, None, "late"
        nr, digest = yield from self.linked(nr, digest, fresh, held)
        self.keep(nr, digest, seen, due, fresh, held)

    def expired(self, fired: int) -> Iterator[Told]:
        nr, digest, seen, _, near, far = self.head.get()
        held = Waiting(self.waiting, near, far)
        if not held:
            self.head.clear()
            yield nr, digest, "closed"
            return
        overdue = True
        while overdue:  # of several gaps that are due at one time each is told
            nr = held.least() - 1
            yield nr, None, "gap"
            nr, digest = yield from self.linked(nr, digest, {}, held)
            known = held.earliest()
            overdue = known is not None and known + self.patience <= fired
        self.keep(nr, digest, seen, None, {}, held, fired)

    @staticmethod
    def linked(nr: int, digest: str, fresh: Lines, held: Waiting) -> Generator[Told, None, tuple[int, str]]:
        """Link what has its turn; where the chain is then."""
        while nr + 1 in fresh or nr + 1 in held:
            nr += 1
            digest = link(digest, fresh.pop(nr)[0] if nr in fresh else held.take(nr))
            yield nr, digest, "linked"
        held.shut()
        return nr, digest

    def keep(self, nr: int, digest: str, seen: int, due: int | None, fresh: Lines, held: Waiting, fired: int = -1) -> None:
        """Let the rest wait, and set the timer for what is left. due: the timer that is set; fired: one that goes after this."""
        held.add(fresh)
        known = held.earliest()
        then = known + self.patience if known is not None else None if held else max(seen + self.forget, fired + 1)
        self.head.update((nr, digest, seen, then, *held.texts()))
        if due is not None and due != then:
            self.handle.deleteTimer(due)
        if then is not None and due != then:
            self.handle.registerTimer(then)

    def close(self) -> None:
        pass


class BundleChain(LineChain):
    """The same with bundles of lines in and runs of numbers out, as a row to or from Python costs far more than its lines."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        return self.runs(key[0], self.came(line for r in rows for line in json.loads(r["lines"])))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        return self.runs(key[0], self.expired(expiredTimerInfo.getExpiryTimeInMs()))

    @staticmethod
    def runs(journal: str, told: Iterator[Told]) -> Iterator[Row]:
        start, status, digests = 0, "", []
        for nr, digest, now in told:
            if digests and (now != status or nr != start + len(digests) or len(digests) >= PART):
                yield Row(journal=journal, nr=start, status=status, digests=digests)
                digests = []
            if not digests:
                start, status = nr, now
            digests.append(digest)
        if digests:
            yield Row(journal=journal, nr=start, status=status, digests=digests)


def bundled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines (journal, nr, us, line) as bundles (journal, us, lines) of one journal each, under the latest time of a line.

    Lines without a time have bundles of their own, so that a bundle is late only if all its lines are.
    """
    held, rows, chars = [], 0, 0
    for f in frames:
        held.append(f)
        rows, chars = rows + len(f), chars + int(f["line"].str.len().sum())
        if rows >= BUNDLED or chars >= BUNDLED_CHARS:
            yield _bundles(pd.concat(held))
            held, rows, chars = [], 0, 0
    if rows:
        yield _bundles(pd.concat(held))


def _bundles(lines: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(lines["journal"])
    which = codes * 2 + (lines["us"].to_numpy() == UNTIMED)
    order = np.lexsort((lines["nr"].to_numpy(), which))
    which, us = which[order], lines["us"].to_numpy()[order]
    nrs, times = lines["nr"].to_numpy()[order].tolist(), (us // 1000).tolist()
    texts = lines["line"].to_numpy()[order].tolist()
    made = []
    bounds = np.flatnonzero(np.r_[True, which[1:] != which[:-1], True]).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        journal, untimed = names[which[a] // 2], which[a] % 2
        while a < b:
            end, chars = a + 1, len(texts[a])
            while end < b and end - a < PART and chars + len(texts[end]) <= PART_CHARS:
                chars += len(texts[end])
                end += 1
            some = [[nr, text, None if untimed else at] for nr, text, at in zip(nrs[a:end], texts[a:end], times[a:end], strict=True)]
            made.append((journal, int(us[a:end].max()), as_text(some)))
            a = end
    return pd.DataFrame(made, columns=["journal", "us", "lines"])


def chained(lines: DataFrame, patience: datetime.timedelta, forget: datetime.timedelta, late: str = "0 seconds") -> DataFrame:
    """A stream of lines (journal, nr, at, line) as rows (journal, nr, digest, status)."""
    ms = lambda d: int(d.total_seconds() * 1000)
    given = lines.where("journal is not null and nr is not null").select(F.col("journal").cast("string").alias("journal"), F.col("nr").cast("long").alias("nr"), F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(UNTIMED)).alias("us"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    bundles = given.repartition("journal").mapInPandas(bundled, "journal string, us long, lines string")
    timed = bundles.select("journal", F.when(F.col("us") != UNTIMED, F.timestamp_micros("us")).alias("at"), "lines").withWatermark("at", late)
    told = timed.groupBy("journal").transformWithState(BundleChain(ms(patience), ms(forget)), "journal string, nr long, status string, digests array<string>", "Append", "EventTime")
    each = told.select("journal", "nr", "status", F.posexplode("digests").alias("_pos", "digest"))
    return each.select("journal", (F.col("nr") + F.col("_pos")).alias("nr"), "digest", "status")
