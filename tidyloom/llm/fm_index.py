"""FM-index of a sequence of small whole numbers, in numpy.

The last column of the sorted suffixes is kept in a wavelet matrix, a wavelet tree whose
levels are stored as one bit row each. Ranks on it give backward search; every sixteenth
position is kept to locate what was found.
"""

from __future__ import annotations

import numpy as np

STEP = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(text)
    rank, span = text.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - span)] = rank[span:] + 1
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair)
        steps = pair[order]
        new = np.concatenate(([0], np.cumsum(steps[1:] != steps[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        span *= 2


class FmIndex:
    """Index of ``text``, whose last symbol, and no other, is 0."""

    def __init__(self, text: np.ndarray):
        order = suffix_array(text)
        column = text[order - 1].astype(np.int64)
        top = int(text.max())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (column >> bit & 1).astype(np.int32)
            self.levels.append((bit, np.concatenate((np.zeros(1, np.int32), np.cumsum(ones, dtype=np.int32))), len(text) - int(ones.sum())))
            column = np.concatenate((column[ones == 0], column[ones == 1]))
        kept = order % STEP == 0
        self.kept, self.places = np.concatenate(([0], np.cumsum(kept))), order[kept]

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the last column before each row."""
        start = np.zeros_like(rows)
        for bit, ones, zeros in self.levels:
            one = (symbols >> bit & 1).astype(bool)
            rows = np.where(one, zeros + ones[rows], rows - ones[rows])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return rows - start

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The row of the suffix that starts one place earlier."""
        symbols, start = np.zeros_like(rows), np.zeros_like(rows)
        for bit, ones, zeros in self.levels:
            one = ones[rows + 1] > ones[rows]
            symbols |= one.astype(np.int64) << bit
            rows = np.where(one, zeros + ones[rows], rows - ones[rows])
            start = np.where(one, zeros + ones[start], start - ones[start])
        return self.first[symbols] + rows - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of the suffixes that begin with each phrase, one phrase a row."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        alive = np.flatnonzero((phrases < len(self.first) - 1).all(axis=1))
        if not len(alive):
            return low, high
        last = phrases[alive, -1]
        a, b = self.first[last], self.first[last + 1]
        for place in range(phrases.shape[1] - 2, -1, -1):
            on = b > a
            alive, a, b = alive[on], a[on], b[on]
            symbols = phrases[alive, place]
            a, b = self.first[symbols] + self.rank(symbols, a), self.first[symbols] + self.rank(symbols, b)
        low[alive], high[alive] = a, b
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of rows start, walking back to the next kept place."""
        found, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            here = self.kept[rows + 1] > self.kept[rows]
            found[at[here]] = self.places[self.kept[rows[here]]] + steps
            at, rows, steps = at[~here], self.back(rows[~here]), steps + 1
        return found
