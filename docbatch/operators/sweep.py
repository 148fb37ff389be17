"""The area that boxes cover together, by a sweep line."""

from __future__ import annotations

import numpy as np


class CoveredLength:
    """A segment tree over neighbouring spans of a line: how much of it is covered, while intervals come and go.

    A node counts the intervals that cover all of it and were put there, and knows how much of it is covered by these or by
    those below.
    """

    def __init__(self, borders: np.ndarray):
        n = len(borders) - 1
        self.size = 1 << max(0, n - 1).bit_length()
        spans = np.zeros(2 * self.size)
        spans[self.size : self.size + n] = np.diff(borders)
        for level in range(self.size.bit_length() - 2, -1, -1):
            at = 1 << level
            spans[at : 2 * at] = spans[2 * at : 4 * at : 2] + spans[2 * at + 1 : 4 * at : 2]
        self.spans = spans.tolist()
        self.count = [0] * (2 * self.size)
        self.covered = [0.0] * (2 * self.size)

    def add(self, low: int, high: int, change: int) -> None:
        """An interval of spans ``low`` to ``high`` (exclusive) comes (1) or goes (-1)."""
        size, count, covered, spans = self.size, self.count, self.covered, self.spans
        a, b = low + size, high + size
        ends = (a, b - 1)
        while a < b:
            for node in ((a,) if a & 1 else ()) + ((b - 1,) if b & 1 else ()):
                count[node] += change
                covered[node] = spans[node] if count[node] else covered[2 * node] + covered[2 * node + 1] if node < size else 0.0
            a, b = (a + 1) >> 1, b >> 1
        for node in ends:
            node >>= 1
            while node:
                covered[node] = spans[node] if count[node] else covered[2 * node] + covered[2 * node + 1]
                node >>= 1

    @property
    def length(self) -> float:
        return self.covered[1]


def union_area(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> float:
    """The area that boxes with positive sides cover, each part of it once."""
    n = len(x0)
    if n < 2:
        return float(((x1 - x0) * (y1 - y0)).sum())
    borders = np.unique(np.r_[y0, y1])
    low, high = np.searchsorted(borders, y0).tolist(), np.searchsorted(borders, y1).tolist()
    xs = np.r_[x0, x1]
    order = np.argsort(xs, kind="stable")
    line, last, area = CoveredLength(borders), 0.0, 0.0
    for x, k in zip(xs[order].tolist(), order.tolist(), strict=True):
        area += line.length * (x - last)
        last = x
        if k < n:
            line.add(low[k], high[k], 1)
        else:
            line.add(low[k - n], high[k - n], -1)
    return area
