"""Where a campaign's next execution goes: a bandit over families, Halton rows, targeted cells and cuts of level sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from plumbline.plans.partition import UNKNOWN, Partition
from plumbline.sources.sample import PRIMES

FAMILIES = ("Random", "Coverage", "Boundary", "Uncertainty", "Contradiction", "Sensitivity", "LevelSet")
RANDOM, COVERAGE, BOUNDARY, UNCERTAINTY, CONTRADICTION, SENSITIVITY, LEVEL_SET = range(len(FAMILIES))
#: The families that a strategy deals its rounds to.
STRATEGIES = {"random": (RANDOM,), "stratified": (COVERAGE,), "adaptive": (COVERAGE, BOUNDARY, UNCERTAINTY, CONTRADICTION, SENSITIVITY), "levelset": (LEVEL_SET,)}
EXPLORE, ALPHA, BONUS, INSET = 0.08, 0.1, 0.05, 0.15
BRACKET = 1e-6


def halton_rows(first: int, n: int, dims: int) -> np.ndarray:
    """n rows of the Halton sequence from index first on, in [0, 1)."""
    out = np.zeros((n, dims))
    for d in range(dims):
        left, place = np.arange(first, first + n), 1.0
        while left.any():
            place /= PRIMES[d % len(PRIMES)]
            out[:, d] += left % PRIMES[d % len(PRIMES)] * place
            left = left // PRIMES[d % len(PRIMES)]
    return out


class Bandit:
    """Upper confidence bounds on a fading mean of what a family's rounds gained."""

    def __init__(self) -> None:
        self.rounds, self.worth = np.zeros(len(FAMILIES), int), np.zeros(len(FAMILIES))

    def pull(self, arms: Sequence[int], draw: Callable[[], float]) -> int:
        if len(arms) > 1 and draw() < EXPLORE and RANDOM in arms:
            return RANDOM
        held = np.array(arms)
        bound = self.worth[held] + BONUS * np.sqrt(2 * np.log(self.rounds.sum() + 1) / np.maximum(self.rounds[held], 1))
        return int(held[bound.argmax()])

    def reward(self, rounds: np.ndarray, gain: float) -> None:
        """So many rounds of each family gained this much, each: as if told one after the other."""
        stays = (1 - ALPHA) ** rounds
        self.worth = stays * self.worth + (1 - stays) * max(gain, 0.0)
        self.rounds += rounds


class Brackets:
    """Points on two sides of a level, and of each leaf the widest pair of them.

    A point that comes is only held against its own leaf's points on the other side; when leaves are halved all pairs
    of a leaf are looked at anew, as a matrix.
    """

    def __init__(self, dims: int) -> None:
        self.x, self.unit = np.empty((0, dims)), np.empty((0, dims))
        self.below = np.empty(0, bool)
        self.leaf = np.empty(0, int)
        self.widest: dict[int, tuple[float, int, int]] = {}
        self.version = 0

    def add(self, x: Sequence[float], unit: Sequence[float], below: bool, space: Partition) -> None:
        n = len(self.below)
        self.x, self.unit = np.vstack([self.x, x]), np.vstack([self.unit, unit])
        self.below, self.leaf = np.append(self.below, below), np.append(self.leaf, max(int(space.holding(x)[0]), 0))
        if self.version == space.version:
            here = np.flatnonzero((self.leaf[:n] == self.leaf[n]) & (self.below[:n] != below))
            self._offer(int(self.leaf[n]), here, np.full(len(here), n), ((self.unit[here] - self.unit[n]) ** 2).sum(1))

    def _offer(self, leaf: int, i: np.ndarray, j: np.ndarray, gap: np.ndarray) -> None:
        """Keep the widest of a leaf's pair and these, in the order of i: the first of equals, by row numbers."""
        if not len(gap) or gap.max() <= BRACKET**2:
            return
        k = int(gap.argmax())
        held = self.widest.get(leaf)
        if held is None or (-gap[k], i[k], j[k]) < (-held[0], *held[1:]):
            self.widest[leaf] = (float(gap[k]), int(i[k]), int(j[k]))

    def _again(self, space: Partition) -> None:
        self.version, self.widest = space.version, {}
        self.leaf = np.maximum(space.holding(self.x), 0) if len(self.x) else self.leaf
        for leaf in np.unique(self.leaf):
            rows = np.flatnonzero(self.leaf == leaf)
            u, below = self.unit[rows], self.below[rows]
            gap = ((u[:, None, :] - u[None, :, :]) ** 2).sum(2)
            gap[~np.triu(below[:, None] != below[None, :], 1)] = 0.0
            flat = int(gap.argmax())
            i, j = divmod(flat, len(rows))
            self._offer(int(leaf), rows[[i]], rows[[j]], gap[[i], [j]])

    def middle(self, space: Partition) -> np.ndarray | None:
        """Half way between the widest pair of the largest leaf that has one, the first of equals."""
        if self.version != space.version:
            self._again(space)
        if not self.widest:
            return None
        volume = space.volume
        _, i, j = self.widest[min(self.widest, key=lambda leaf: (-volume[leaf], leaf))]
        return (self.unit[i] + self.unit[j]) / 2


def target(space: Partition, family: int) -> int | None:
    """The leaf that a family aims at, if any."""
    leaves = space.leaves
    leaves = leaves[space.samples[leaves] > 0]
    if family == UNCERTAINTY:
        return int(leaves[space.samples[leaves].argmin()]) if len(leaves) else None
    fit = space.label[leaves] != UNKNOWN if family == BOUNDARY else np.bitwise_count(space.channels[leaves]) > 1
    leaves = leaves[fit]
    heat = space.peak[leaves] + space.mean[leaves]
    return int(leaves[len(leaves) - 1 - heat[::-1].argmax()]) if len(leaves) else None


class Placement:
    """Points of the unit cube for one campaign."""

    def __init__(self, space: Partition, draw: Callable[[], float]) -> None:
        self.space, self.draw = space, draw
        self.dims = space.low.shape[1]
        self.brackets = Brackets(self.dims)
        self.next = 1
        self.rows = np.empty((0, self.dims))

    def spread(self) -> np.ndarray:
        """The next row of the Halton sequence."""
        at = (self.next - 1) % 256
        if at == 0:
            self.rows = halton_rows(self.next, 256, self.dims)
        self.next += 1
        return self.rows[at]

    def point(self, family: int) -> list[float]:
        if family == COVERAGE:
            return self.spread().tolist()
        if family == LEVEL_SET:
            cut = self.brackets.middle(self.space)
            return (self.spread() if cut is None else cut).tolist()
        cell = target(self.space, family) if family in (BOUNDARY, UNCERTAINTY, CONTRADICTION) else None
        if cell is None:
            return [self.draw() for _ in range(self.dims)]
        low, high, root = self.space.low[cell], self.space.high[cell], self.space.low[0]
        wide = self.space.high[0] > root
        begin, end = low + (high - low) * INSET, high - (high - low) * INSET
        out = np.full(self.dims, 0.5)
        share = np.array([self.draw() if w else 0.0 for w in wide])
        out[wide] = ((begin - root) / self.space.span + (end - begin) / self.space.span * share)[wide]
        return out.tolist()
