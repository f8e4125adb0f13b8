"""How many weighted points lie within a radius of a spot in the plane, and the median of their heights, on arrays.

Where points share few x, those within the radius of a spot are a run of each line's points by y. Its ends come from a binary
search, its weight from running sums and the median from a wavelet matrix of the heights, so the work for a spot grows with
its lines and the digits of the heights' ranks and not with the points around it."""

from __future__ import annotations

import numpy as np

LINED = 4       # points on a line from which the runs pay
ASKED = 1 << 13


def few_lines(q) -> bool:
    return len(q) >= LINED * len(np.unique(q[:, 0]))


def _first(low, high, beyond):
    """The first position in [low, high) for which beyond holds, position by position (high where there is none)."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) // 2
        holds = beyond(open_, middle)
        high[open_[holds]] = middle[holds]
        low[open_[~holds]] = middle[~holds] + 1
        open_ = open_[low[open_] < high[open_]]
    return low


class Lines:
    """Points q (x, y) with heights z (NaN: none) and weights w, by line."""

    def __init__(self, q, z, w, radius: float):
        order = np.lexsort((q[:, 1], q[:, 0]))
        self.q, z, w, self.radius = q[order], z[order], w[order], radius
        self.x, self.start = np.unique(self.q[:, 0], return_index=True)
        self.end = np.r_[self.start[1:], len(q)]
        self.weight = np.r_[0, np.cumsum(w)]
        high = ~np.isnan(z)
        self.heights, rank = np.unique(z[high], return_inverse=True)
        ranks, w = np.zeros(len(z), np.int64), np.where(high, w, 0)
        ranks[high] = rank.ravel()
        self.high, self.levels = np.r_[0, np.cumsum(w)], []
        for bit in reversed(range(max(len(self.heights) - 1, 0).bit_length())):
            zero = (ranks >> bit) & 1 == 0
            self.levels.append((bit, np.r_[0, np.cumsum(zero)], np.r_[0, np.cumsum(np.where(zero, w, 0))]))
            order = np.r_[np.flatnonzero(zero), np.flatnonzero(~zero)]
            ranks, w = ranks[order], w[order]

    def around(self, p):
        """Weight within the radius and median height (NaN: none) of each spot p."""
        support, median = np.zeros(len(p), np.int64), np.full(len(p), np.nan)
        for start in range(0, len(p), ASKED):
            at = slice(start, start + ASKED)
            support[at], median[at] = self._around(p[at])
        return support, median

    def _around(self, p):
        support, median = np.zeros(len(p), np.int64), np.full(len(p), np.nan)
        reach = self.radius * (1 + 1e-9) + 1e-12
        a, b = np.searchsorted(self.x, p[:, 0] - reach), np.searchsorted(self.x, p[:, 0] + reach, "right")
        spots = np.flatnonzero(b > a)
        if not len(spots):
            return support, median
        n = (b - a)[spots]
        lead = np.cumsum(n) - n
        of = np.repeat(np.arange(len(spots)), n)
        line = np.arange(len(of)) - lead[of] + a[spots][of]
        px, py = p[spots[of], 0], p[spots[of], 1]

        def outside(k, at):
            dx, dy = px[k] - self.q[at, 0], py[k] - self.q[at, 1]
            return ~(np.sqrt(dx * dx + dy * dy) <= self.radius)

        low = _first(self.start[line], self.end[line], lambda k, at: (self.q[at, 1] >= py[k]) | ~outside(k, at))
        high = _first(low, self.end[line], lambda k, at: (self.q[at, 1] >= py[k]) & outside(k, at))
        support[spots] = np.add.reduceat(self.weight[high] - self.weight[low], lead)
        count = np.add.reduceat(self.high[high] - self.high[low], lead)
        there = count > 0
        if there.any():
            ends = [self.heights[self._ranked(low, high, lead, of, np.where(there, k, 0))] for k in ((count - 1) // 2, count // 2)]
            median[spots[there]] = ((ends[0] + ends[1]) / 2)[there]
        return support, median

    def _ranked(self, low, high, lead, of, k):
        """Rank of the height that holds the k-th unit of weight in each spot's runs."""
        rank, k = np.zeros(len(k), np.int64), k.copy()
        for bit, zeros, weight in self.levels:
            below = np.add.reduceat(weight[high] - weight[low], lead)
            up = k >= below
            k = np.where(up, k - below, k)
            rank |= np.where(up, 1 << bit, 0)
            low, high = (np.where(up[of], zeros[-1] + v - zeros[v], zeros[v]) for v in (low, high))
        return np.minimum(rank, len(self.heights) - 1)
