"""FM-index over a sequence of small integers: suffix order, wavelet ranks, sampled positions; all in numpy."""

from __future__ import annotations

import numpy as np

#: Every so many text positions keep their place in the suffix order.
SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in sorted order, by prefix doubling. The last symbol must be the only smallest."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        second = np.full(n, 0, np.int64)
        second[: n - width] = rank[width:] + 1
        pair = rank * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        rank = new
        width *= 2
        if width >= n or rank[order[-1]] == n - 1:
            return order if rank[order[-1]] == n - 1 else np.argsort(rank, kind="stable")


class Wavelet:
    """Bit planes of a sequence with rank counts: how often a symbol occurs before a position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = len(now) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, at = np.zeros(len(at), np.int64), at.copy()
        for b, ones, zeros in self.levels:
            up = ((symbol >> b) & 1).astype(bool)
            a, c = ones[low], ones[at]
            low = np.where(up, zeros + a, low - a)
            at = np.where(up, zeros + c, at - c)
        return at - low


class FmIndex:
    def __init__(self, text: np.ndarray):
        """``text``: non-negative integers; 0 is used as a separator that no phrase contains."""
        whole = np.append(text.astype(np.int64) + 1, 0)
        order = suffix_order(whole)
        last = whole[order - 1]
        self.top = int(whole.max(initial=0))
        self.ranks = Wavelet(last, max(1, self.top.bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=self.top + 1))])
        self.last, self.n = last, len(whole)
        kept = order % SAMPLE == 0
        self.sampled = np.where(kept, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each phrase; row p has its symbols at the right end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(lengths[alive] >= step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            c = phrases[alive, phrases.shape[1] - step].astype(np.int64) + 1
            known = c <= self.top
            c = np.minimum(c, self.top)
            base = self.before[c]
            low[alive] = np.where(known, base + self.ranks.rank(c, low[alive]), 0)
            high[alive] = np.where(known, base + self.ranks.rank(c, high[alive]), 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order, walking back to the next sampled one."""
        out, at, steps = np.full(len(rows), -1, np.int64), rows.copy(), 0
        todo = np.arange(len(rows))
        while len(todo):
            found = self.sampled[at[todo]]
            hit = found >= 0
            out[todo[hit]] = found[hit] + steps
            todo = todo[~hit]
            c = self.last[at[todo]]
            at[todo] = self.before[c] + self.ranks.rank(c, at[todo])
            steps += 1
        return out
