"""A hash table of 64-bit keys and 32-bit values in numpy arrays, found and filled by whole arrays."""

from __future__ import annotations

import numpy as np


class HashTable:
    """Open addresses; 0 is no key.  Room for ``most`` keys with a load of at most a half."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.mask = (1 << (2 * most).bit_length()) - 1
        self.keys, self.values = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.count = 0

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 for those not there."""
        out = np.full(len(keys), -1, np.int32)
        at, left = self._start(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (there != 0)
            left, at = left[go], (at[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.count += len(keys)
        at, left = self._start(keys), np.arange(len(keys))
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = keys[left[won]], values[left[won]]
            go = np.ones(len(left), bool)
            go[won] = False
            left, at = left[go], (at[go] + 1) & self.mask

    def wider(self, most: int) -> HashTable:
        """A table with the same keys and room for more."""
        out, used = HashTable(most), self.keys != 0
        out.add(self.keys[used], self.values[used])
        return out
