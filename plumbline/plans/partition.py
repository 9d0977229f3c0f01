"""The partition of a campaign's space, as arrays: boxes and tallies by cell, measurements by row.

A cell is a row of ``low``, ``high`` and the tallies; leaves are the rows without halves. A measurement is filed under the
first leaf whose closed box holds it. Cells are judged, and halved, all at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from plumbline.operators.atlas import FACE, Policy
from plumbline.sources.sample import Axis

#: Labels by code. PROVISIONAL is on the side of TRUSTED.
LABELS = ("UNKNOWN", "SUSPICIOUS", "TRUSTED", "PROVISIONAL")
UNKNOWN, SUSPICIOUS, TRUSTED, PROVISIONAL = range(4)


def extent(a: Axis) -> tuple[float, float]:
    """The least and the largest value of an axis."""
    return (min(a.choices), max(a.choices)) if a.discrete else (a.lo, a.hi)


class Partition:
    def __init__(self, params: Sequence[Axis], policy: Policy) -> None:
        root = np.array([extent(a) for a in params]).reshape(-1, 2)
        self.policy = policy
        self.low, self.high = root[:, 0][None, :].copy(), root[:, 1][None, :].copy()
        self.span = np.maximum(self.high[0] - self.low[0], 1e-30)
        self.depth, self.halved, self.label = np.zeros(1, int), np.zeros(1, bool), np.zeros(1, int)
        self.outside = 0
        #: Counts every change of the leaves.
        self.version = 0
        self.forget()

    def forget(self) -> None:
        """Drop all measurements; boxes stay."""
        dims = self.low.shape[1]
        self.rows = 0
        self.x, self.risk, self.speaking = np.empty((64, dims)), np.empty(64), np.empty(64, int)
        self.reading, self.fact, self.cell = np.empty(64, int), np.empty(64, bool), np.empty(64, int)
        n = len(self.low)
        self.samples, self.total, self.peak = np.zeros(n, int), np.zeros(n), np.zeros(n)
        self.channels, self.measured = np.zeros(n, int), np.zeros(n, int)
        self.strong, self.broken = np.zeros(n, bool), np.zeros(n, bool)

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(~self.halved)

    @property
    def mean(self) -> np.ndarray:
        return np.divide(self.total, self.samples, out=np.zeros(len(self.total)), where=self.samples > 0)

    @property
    def volume(self) -> np.ndarray:
        return np.prod((self.high - self.low) / self.span, axis=1)

    def box(self, cell: int) -> list[tuple[float, float]]:
        return list(zip(self.low[cell].tolist(), self.high[cell].tolist(), strict=True))

    def holding(self, x: np.ndarray) -> np.ndarray:
        """For each row of x the first leaf that holds it, -1 without one."""
        leaves = self.leaves
        x = np.atleast_2d(np.asarray(x, float))
        inside = ((self.low[leaves] <= x[:, None, :]) & (x[:, None, :] <= self.high[leaves])).all(2)
        return np.where(inside.any(1), leaves[inside.argmax(1)], -1)

    def add(self, x: Sequence[float], risk: float, speaking: int, reading: int, fact: bool) -> int:
        """File a measurement; the cell that it is in (the whole space where no leaf holds it)."""
        at = int(self.holding(x)[0])
        self.outside += at < 0
        at = max(at, 0)
        if self.rows == len(self.risk):
            for name in ("x", "risk", "speaking", "reading", "fact", "cell"):
                held = getattr(self, name)
                setattr(self, name, np.concatenate([held, np.empty_like(held)]))
        n, self.rows = self.rows, self.rows + 1
        self.x[n], self.risk[n], self.speaking[n], self.reading[n], self.fact[n], self.cell[n] = x, risk, speaking, reading, fact, at
        self.tally(np.array([n]))
        return at

    def tally(self, rows: np.ndarray) -> None:
        """Add measurements to the tallies of their cells, in their order."""
        at, risk, p = self.cell[rows], self.risk[rows], self.policy
        n = len(self.samples)
        self.samples += np.bincount(at, minlength=n)
        np.add.at(self.total, at, risk)
        np.fmax.at(self.peak, at, risk)
        np.bitwise_or.at(self.channels, at, self.speaking[rows])
        np.bitwise_or.at(self.measured, at, self.reading[rows])
        well = (risk >= p.suspicious_mean) & (self.fact[rows] | (np.bitwise_count(self.speaking[rows]) >= p.suspicious_channels))
        self.strong[at[well]] = True
        self.broken[at[~np.isfinite(risk)]] = True

    def refill(self, x: np.ndarray, risk: np.ndarray, speaking: np.ndarray, reading: np.ndarray, fact: np.ndarray) -> None:
        """File other measurements in place of those there are, and judge."""
        self.forget()
        found = self.holding(x) if len(x) else np.empty(0, int)
        self.outside += int((found < 0).sum())
        self.rows = len(x)
        self.x, self.risk, self.speaking = np.array(x, float).reshape(len(x), -1), np.array(risk, float), np.array(speaking, int)
        self.reading, self.fact, self.cell = np.array(reading, int), np.array(fact, bool), np.maximum(found, 0)
        self.tally(np.arange(self.rows))
        self.judge()

    def thin(self) -> np.ndarray:
        """Cells with too little support to be certified."""
        share, p = 0.5**self.depth, self.policy
        return share > p.certify_share if p.certify == "size" else self.samples / share < p.certify_density

    def judge(self) -> None:
        """Label every leaf by its measurements."""
        p, mean = self.policy, self.mean
        hot = (self.peak >= p.suspicious_peak) | (mean >= p.suspicious_mean)
        poor = (self.samples < p.min_samples) | (np.bitwise_count(self.measured) < p.channels_floor)
        if p.blocks_non_finite:
            poor |= self.broken
        fine = np.where(self.thin(), PROVISIONAL, TRUSTED) if p.resolution in ("withhold", "both") else np.full(len(mean), TRUSTED)
        label = np.where(hot, np.where(self.strong, SUSPICIOUS, UNKNOWN), np.where(poor, UNKNOWN, fine))
        self.label = np.where(self.halved, self.label, np.where(np.isnan(mean), UNKNOWN, label))

    def side(self, cells: np.ndarray) -> np.ndarray:
        return np.minimum(self.label[cells], TRUSTED)

    def touching(self, cells: np.ndarray) -> np.ndarray:
        """Whether closed boxes meet, by axis, for each two cells."""
        low, high = self.low[cells], self.high[cells]
        ahead = high[:, None, :] >= low[None, :, :] - FACE
        return ahead & ahead.transpose(1, 0, 2)

    def divide(self) -> int:
        """Halve the leaves that are worth it, by the labels there are; then judge. How many cells are new."""
        p, leaves = self.policy, self.leaves
        known = (self.samples[leaves] > 0) & (self.label[leaves] != UNKNOWN)
        side = self.side(leaves)
        contrast = self.touching(leaves).all(2) & (side[:, None] != side[None, :]) & known[None, :]
        worth = (self.label[leaves] == SUSPICIOUS) | (self.mean[leaves] > p.refine_below) | ((self.label[leaves] != UNKNOWN) & contrast.any(1))
        if p.resolution in ("demand", "both"):
            worth |= (side == TRUSTED) & self.thin()[leaves]
        worth &= (self.depth[leaves] < p.max_depth) & (self.samples[leaves] >= p.min_samples)
        new = self.halve(leaves[worth])
        self.judge()
        return new

    def halve(self, cells: np.ndarray) -> int:
        """Halve cells on their relatively widest axis, the last of equals, and deal their measurements; how many cells are new."""
        if not len(cells):
            return 0
        share = (self.high[cells] - self.low[cells]) / self.span
        axis = share.shape[1] - 1 - share[:, ::-1].argmax(1)
        each = np.arange(len(cells))
        mid = (self.low[cells, axis] + self.high[cells, axis]) / 2
        able = (self.low[cells, axis] < mid) & (mid < self.high[cells, axis])
        cells, axis, mid, each = cells[able], axis[able], mid[able], each[: int(able.sum())]
        if not len(cells):
            return 0
        first = len(self.low)
        low, high = np.repeat(self.low[cells], 2, axis=0), np.repeat(self.high[cells], 2, axis=0)
        high[2 * each, axis], low[2 * each + 1, axis] = mid, mid
        self.low, self.high = np.concatenate([self.low, low]), np.concatenate([self.high, high])
        self.halved[cells] = True
        self.depth = np.concatenate([self.depth, np.repeat(self.depth[cells] + 1, 2)])
        for name in ("halved", "label", "samples", "total", "peak", "channels", "measured", "strong", "broken"):
            held = getattr(self, name)
            setattr(self, name, np.concatenate([held, np.zeros(2 * len(cells), held.dtype)]))
        number = np.full(first, -1)
        number[cells] = each
        k = number[self.cell[: self.rows]]
        rows = np.flatnonzero(k >= 0)
        k = k[rows]
        self.cell[rows] = first + 2 * k + (self.x[rows, axis[k]] > mid[k])
        self.tally(rows)
        self.version += 1
        return 2 * len(cells)

    def edges(self) -> list[dict]:
        """Where labels of different sides face each other, axis by axis; those that overlap are one."""
        leaves = self.leaves
        leaves = leaves[(self.samples[leaves] > 0) & (self.label[leaves] != UNKNOWN)]
        if not len(leaves):
            return []
        low, high, side, meets = self.low[leaves], self.high[leaves], self.side(leaves), self.touching(leaves)
        apart = high[:, None, :] <= low[None, :, :] + FACE
        others = meets.sum(2, keepdims=True) - meets == meets.shape[2] - 1
        facing = (apart | apart.transpose(1, 0, 2)) & others & np.triu(side[:, None] != side[None, :], 1)[:, :, None]
        i, j, axis = np.nonzero(facing)
        a, b = (low[i, axis], high[i, axis]), (low[j, axis], high[j, axis])
        lo, hi = np.minimum(a[0], b[0]), np.maximum(a[1], b[1])
        near, far = np.minimum(a[1], b[1]), np.maximum(a[0], b[0])
        by = np.lexsort((np.arange(len(lo)), lo, axis))
        axis, lo, hi, near, far = axis[by], lo[by], hi[by], near[by], far[by]
        out = []
        for d in np.unique(axis):
            of = np.flatnonzero(axis == d)
            reach = np.maximum.accumulate(hi[of])
            starts = np.concatenate([[0], np.flatnonzero(lo[of][1:] > reach[:-1]) + 1])
            ends = np.append(starts[1:], len(of))
            for s, e in zip(starts, ends, strict=True):
                run = of[s:e]
                out.append({"axis": int(d), "lo": float(lo[run[0]]), "hi": float(hi[run].max()), "facing_lo": float(near[run].min()), "facing_hi": float(far[run].max()), "transitions": len(run)})
        return out

    def shares(self) -> dict[str, float]:
        """The share of the space under each label."""
        leaves = self.leaves
        sums = np.bincount(self.label[leaves], self.volume[leaves], len(LABELS))
        return {LABELS[k].lower(): float(sums[k]) for k in (TRUSTED, SUSPICIOUS, UNKNOWN, PROVISIONAL)}

    def table(self) -> list[dict]:
        """The leaves, one after the other."""
        mean = self.mean
        return [
            {
                "cell": int(i), "seq": n, "depth": int(self.depth[i]), "label": LABELS[self.label[i]], "samples": int(self.samples[i]), "mean_risk": float(mean[i]), "max_risk": float(self.peak[i]),
                "channels": int(self.channels[i]), "measured": int(self.measured[i]), "lo": self.low[i].tolist(), "hi": self.high[i].tolist(),
            }
            for n, i in enumerate(self.leaves)
        ]
