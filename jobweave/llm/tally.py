"""Sums by number key inside a task, held in a few arrays."""

from __future__ import annotations

import numpy as np


class Tally:
    """Sums by 64-bit key; equal keys are merged whenever the held entries have doubled."""

    def __init__(self, least: int = 1 << 18):
        self.keys, self.sums, self.n, self.merged, self.least = [], [], 0, 0, least

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.keys.append(keys)
        self.sums.append(sums)
        self.n += len(keys)
        if self.n > 2 * max(self.merged, self.least):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order and their sums."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.bincount(place, np.concatenate(self.sums), len(keys)).astype(np.int64)
        self.keys, self.sums, self.n, self.merged = [keys], [sums], len(keys), len(keys)
        return keys, sums
