"""A minimal perfect hash over 64-bit keys, built and probed with numpy.

Keys are placed level by level: at each level every key not yet placed hashes
to one bit of an array twice as large as their number; bits hit by exactly one
key are kept, and the other keys go to the next level. A key's index is the
rank of its bit over all levels, so n keys fill the indexes 0 to n-1.
"""

from __future__ import annotations

import numpy as np

_GAMMA = 2
_LEVELS = 48
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A well mixed 64-bit hash of 64-bit keys."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((salt + 1) * _MIX[0] & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """``sizes``: bits of each level; ``bits``: all levels, one after another."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes.astype(np.int64), bits
        self._starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self._ranks = np.concatenate(([0], np.cumsum(_POPCOUNT[bits], dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """``keys`` are distinct unsigned 64-bit integers."""
        left, sizes, levels = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-_GAMMA * len(left) // 8) * 8
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1 where a key surely wasn't built in."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self._starts[level]
            byte, bit = at >> 3, at & 7
            found = self.bits[byte] >> bit.astype(np.uint8) & 1 == 1
            hit, byte, bit = left[found], byte[found], bit[found]
            below = self.bits[byte] & ((1 << bit) - 1).astype(np.uint8)
            out[hit] = self._ranks[byte] + _POPCOUNT[below]
            left = left[~found]
        return out
