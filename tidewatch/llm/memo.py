"""A table of 64-bit keys in numpy arrays, for what a worker has already worked out."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class KeyTable:
    """Slots of up to ``limit`` well-mixed keys, by open addressing; values are arrays over slots."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.size = 1 << (2 * limit - 1).bit_length()
        self.keys = np.zeros(self.size, _U)
        self.count = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for those that are not held."""
        keys = np.where(keys == 0, _U(1), keys)
        slot = (keys & _U(self.size - 1)).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == keys, slot, -1)
        left = np.flatnonzero((held != keys) & (held != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (self.size - 1)
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (held != 0)]
        return out

    def room(self, n: int) -> bool:
        return self.count + n <= self.limit

    def clear(self) -> None:
        self.keys[:] = 0
        self.count = 0

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Slots for distinct keys that are not held yet; there must be room."""
        keys = np.where(keys == 0, _U(1), keys)
        slot = (keys & _U(self.size - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (self.size - 1)
        self.count += len(keys)
        return slot


class Memo:
    """One number for each key that a worker has met, up to a limit, then it starts again."""

    def __init__(self, limit: int, kind: type) -> None:
        self.table = KeyTable(limit)
        self.values = np.zeros(self.table.size, kind)

    def look_up(self, keys: np.ndarray, solve) -> np.ndarray:
        """Values of keys; ``solve`` gets places of the new ones in ``keys`` and returns theirs."""
        slot = self.table.find(keys)
        out = np.where(slot >= 0, self.values[slot], 0)
        missing = np.flatnonzero(slot < 0)
        if not len(missing):
            return out
        new, first, where = np.unique(keys[missing], return_index=True, return_inverse=True)
        values = solve(missing[first])
        out[missing] = values[where]
        if not self.table.room(len(new)):
            self.table.clear()
        if self.table.room(len(new)):
            self.values[self.table.add(new)] = values
        return out
