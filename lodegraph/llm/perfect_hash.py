"""Minimal perfect hash functions over 64-bit keys, in levels of bit arrays.

On each level the keys that are left are hashed into a bit array of twice their number; a key that is alone on its
bit stays there, the others go on.  The index of a key is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
#: Room for each remaining key on a level.
SPREAD = 2


def mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys + np.uint64(_ODD * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels, and their bits one after another, for distinct keys."""
    sizes, bits, level = [], [], 0
    while len(keys):
        size = SPREAD * len(keys) + 1
        at = mix(keys, level) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        keys = keys[~alone[at.astype(np.int64)]]
        level += 1
    return np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)


class Index:
    """Index of each key; a key outside the set gets -1 or any index."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = start + (mix(keys[left], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[at]
            out[left[here]] = self.before[at[here]]
            left = left[~here]
            start += size
        return out
