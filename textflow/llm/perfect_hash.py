"""A minimal perfect hash over 128-bit keys, as numpy arrays.

Level by level, every key that is left picks one bit of a bit array about as
long as there are keys; a bit that one key alone picks is set and that key is
done, the others go on to the next level.  The number of set bits before a
key's bit is its index, so n keys have the indexes 0 to n - 1.  Looking a key
up costs a bit test a level; a foreign key may land on some index, so what is
stored there has to be compared with it.
"""

from __future__ import annotations

import numpy as np

from textflow.llm.words import mix

_U = np.uint64


def _slots(one: np.ndarray, two: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bit that each key picks at a level; another level, another choice."""
    return (mix(one ^ mix(two + _U(level))) % _U(bits)).astype(np.int64)


class PerfectHash:
    """``sizes``: bits of each level, a multiple of 64; ``words``: the bits of
    all levels; ``before``: set bits before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def of(cls, one: np.ndarray, two: np.ndarray) -> PerfectHash:
        """Of distinct keys, given as their two halves (uint64)."""
        sizes, words, level = [], [], 0
        while len(one):
            bits = -(-len(one) // 64) * 64
            slot = _slots(one, two, level, bits)
            alone = np.bincount(slot, minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view(_U))
            left = ~alone[slot]
            one, two, level = one[left], two[left], level + 1
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, _U))

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for a key that no level has (a foreign one)."""
        found, left, base = np.full(len(one), -1, np.int64), np.arange(len(one)), 0
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            slot = base + _slots(one[left], two[left], level, int(bits))
            word, bit = self.words[slot >> 6], (slot & 63).astype(_U)
            here = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            found[left[here]] = (self.before[slot >> 6] + below)[here]
            left, base = left[~here], base + int(bits)
        return found
