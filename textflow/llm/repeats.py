"""Internal pattern matching in sequences of numbers.

:class:`Factors` names all factors (stretches) whose length is a power of two:
two of them are equal where their names are, and the name is the first place
of such factors in the suffix array, which is refined level by level and only
where factors are still equal.  A wavelet matrix over the suffix array finds
the next occurrence of a factor after any position (range successor).

:func:`runs` finds all maximal repetitions of at least four periods.  A run of
period q contains a block of length B (a power of two, B <= q < 2B) that
begins at a multiple of B and stands again q further on.  So every such block
asks for its occurrences that begin B to 2B - 1 after its own.  These form one
arithmetic progression, of which three numbers are enough (how many, the first,
the second), and its members give candidate periods; the common extension of
the two occurrences to both sides decides.  Members that lie with the block in
one stretch of the progression's difference have a smaller period and are left out.
"""

from __future__ import annotations

import numpy as np


class Factors:
    """``s``: numbers, of which every sequence ends in one that stands nowhere else."""

    def __init__(self, s: np.ndarray, longest: int):
        """``longest``: no factor longer than this is asked for."""
        n = len(s)
        self.sa = np.argsort(s, kind="stable").astype(np.int32)
        head = np.append(True, s[self.sa[1:]] != s[self.sa[:-1]])
        slot = np.arange(n, dtype=np.int32)
        name = np.empty(n, np.int32)
        name[self.sa] = np.maximum.accumulate(np.where(head, slot, 0))
        self.names, self.sizes = [name], [np.bincount(name, minlength=n).astype(np.int32)]
        width = 1
        while 2 * width <= longest:
            open_ = np.flatnonzero(~(head & np.append(head[1:], True)))  # where factors are still equal
            if not len(open_):
                break
            at = self.sa[open_]
            key = name[at].astype(np.int64) * n + name[at + width]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            self.sa[open_] = at
            first = np.append(True, key[1:] != key[:-1])
            head = head.copy()
            head[open_] = first
            name = name.copy()
            name[at] = np.maximum.accumulate(np.where(first, open_, 0))
            self.names.append(name)
            self.sizes.append(np.bincount(name, minlength=n).astype(np.int32))
            width *= 2

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How far the factors that begin at i and at j > i (``back``: that end before them) agree."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        total = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            going = np.arange(len(i))
            while len(going):
                a, b = i[going] + total[going], j[going] + total[going]
                if back:
                    a, b = i[going] - total[going] - width, j[going] - total[going] - width
                same = (a >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])
                going = going[same]
                total[going] += width
                if level < len(self.names) - 1:
                    break
        return total


class Wavelet:
    """Range counts and range selection over a permutation of 0..n-1."""

    def __init__(self, values: np.ndarray):
        self.zeros, self.cut = [], []
        self.bits = max(1, int(len(values) - 1).bit_length())
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            self.cut.append(int(zeros[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of the values at places low..high-1 are less than ``value``."""
        low, high, out = low.astype(np.int64), high.astype(np.int64), np.zeros(len(low), np.int64)
        whole = high - low
        for zeros, cut, bit in zip(self.zeros, self.cut, range(self.bits - 1, -1, -1)):
            a, b = zeros[low], zeros[high]
            one = (value >> bit & 1).astype(bool)
            out += np.where(one, b - a, 0)
            low, high = np.where(one, cut + low - a, a), np.where(one, cut + high - b, b)
        return np.where(value >> self.bits > 0, whole, out)

    def nth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least (from 0) of the values at places low..high-1."""
        low, high, k, out = low.astype(np.int64), high.astype(np.int64), k.astype(np.int64), np.zeros(len(low), np.int64)
        for zeros, cut, bit in zip(self.zeros, self.cut, range(self.bits - 1, -1, -1)):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            out |= one.astype(np.int64) << bit
            low, high = np.where(one, cut + low - a, a), np.where(one, cut + high - b, b)
        return out


#: Candidates that are looked at together.
TOGETHER = 1 << 18


def runs(s: np.ndarray, longest: int, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of all maximal runs of at least ``least``
    numbers and ``times`` periods (4 or more), by start and period.  ``s``: as for
    :class:`Factors`; ``longest``: the length of the longest sequence in it."""
    if times < 4:
        raise ValueError("runs of fewer than four periods may hold no block that stands twice")
    found = [np.zeros((0, 3), np.int64)]
    if longest < max(least, times):
        return found[0][:, 0], found[0][:, 1], found[0][:, 2]
    factors = Factors(s, max(1, longest // times))

    def verify(at: np.ndarray, again: np.ndarray) -> None:
        start = at - factors.extend(at, again, back=True)
        end = again + factors.extend(at, again)
        fits = end - start >= np.maximum(least, times * (again - at))
        found.append(np.unique(np.stack([start, end, again - at], 1)[fits], axis=0))

    same = np.append(False, s[1:] == s[:-1])
    first = np.flatnonzero(np.append(same[1:], False) & ~same)
    verify(first, first + 1)
    wavelet = None
    for level in range(1, len(factors.names)):
        width, name, size = 1 << level, factors.names[level], factors.sizes[level]
        every = np.arange(0, len(s), width)
        every = every[size[name[every]] > 1]
        if not len(every):
            break
        wavelet = wavelet or Wavelet(factors.sa)
        for low_at in range(0, len(every), TOGETHER):
            at = every[low_at:low_at + TOGETHER]
            low = name[at].astype(np.int64)
            high = low + size[name[at]]
            before = wavelet.below(low, high, at + width)
            n = wavelet.below(low, high, at + 2 * width) - before
            some = n > 0
            at, low, high, before, n = at[some], low[some], high[some], before[some], n[some]
            if not len(at):
                continue
            one = wavelet.nth(low, high, before)
            two = one.copy()
            more = n > 1
            two[more] = wavelet.nth(low[more], high[more], before[more] + 1)
            step = two - one
            # how far the block's own stretch of period ``step`` goes
            reach, many = at.copy(), n > 2
            reach[many] = at[many] + step[many] + factors.extend(at[many], at[many] + step[many])
            gone = np.where(many, np.clip((reach - width - one) // np.maximum(step, 1) + 1, 0, n), 0)
            left = n - gone
            whose = np.repeat(np.arange(len(at)), left)
            nth = np.arange(len(whose)) - np.repeat(np.cumsum(left) - left, left) + gone[whose]
            for part in range(0, len(whose), TOGETHER):
                w = whose[part:part + TOGETHER]
                verify(at[w], one[w] + nth[part:part + TOGETHER] * step[w])
    every = np.concatenate(found)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    keep = np.append(True, (every[1:, :2] != every[:-1, :2]).any(1)) if len(every) else np.zeros(0, bool)
    every = every[keep]  # of periods of the same stretch the smallest
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]
