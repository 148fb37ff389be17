"""A vectorised hash map from unsigned 64-bit keys to 64-bit values, for lock-step automata and merge tables."""

from __future__ import annotations

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class U64Map:
    """Open addressing with linear probing; all lookups and inserts are over whole arrays.

    The key 2**64-1 is reserved. ``get`` returns ``missing`` for keys that are absent.
    """

    def __init__(self, bits: int = 12, missing: int = -1):
        self.missing = missing
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.full(1 << bits, _EMPTY, dtype=np.uint64)
        self.values = np.full(1 << bits, self.missing, dtype=np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], self.missing)
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        while todo.size:
            slot[todo] = (slot[todo] + 1) & mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys must be distinct and absent."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            old = self.keys != _EMPTY
            held = self.keys[old], self.values[old]
            self._alloc(max(self.bits + 1, int(np.ceil(np.log2((len(held[0]) + len(keys)) * 3 + 1)))))
            self.put(*held)
        self.n += len(keys)
        mask = (1 << self.bits) - 1
        slot, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            at = slot[todo]
            free = self.keys[at] == _EMPTY
            trying = todo[free]
            self.keys[slot[trying]] = keys[trying]  # of several keys that meet in a slot one stays
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & mask
