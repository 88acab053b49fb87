"""Numbers that describe passages of words, for many texts at once."""

from __future__ import annotations

import numpy as np

from textflow.llm.words import RunHasher, Texts

#: Words of a passage.
PASSAGE = 48

_KIND = np.zeros(256, np.uint8)  # of a byte
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in "#*$%&|<>"]] = 6
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?#*$%&|<>"]] = 7
_KIND[128:] = 8
FEATURES = 20


def passages(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(features of each passage, first passage of each text and one more).
    Every text is cut into runs of PASSAGE words, whole; the last may be
    shorter.  A text without words has one passage, all zeros."""
    words = np.diff(t.first)
    per = np.maximum(1, -(-words // PASSAGE))
    first = np.append(0, np.cumsum(per))
    owner = np.repeat(np.arange(len(words)), per)
    low = t.first[owner] + (np.arange(first[-1]) - first[owner]) * PASSAGE
    high = np.minimum(low + PASSAGE, t.first[owner + 1])
    n = high - low
    out = np.zeros((len(n), FEATURES), np.float32)
    full = n > 0
    if not full.any():
        return out, first
    low, high, n = low[full], high[full], n[full].astype(np.float64)
    size = (t.end - t.start).astype(np.float64)
    word = RunHasher(t.buf)(t.start, t.end)
    kinds = _KIND[t.buf]
    same = np.append(False, word[1:] == word[:-1])
    same[low] = False
    x = np.zeros((len(n), FEATURES))

    def total(per_word: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(per_word, dtype=np.float64))
        return sums[high] - sums[low]

    begin, stop = t.start[low], t.end[high - 1]
    chars = total(size)
    for k in range(1, 9):
        sums = np.append(0, np.cumsum(kinds == k))
        x[:, k - 1] = (sums[stop] - sums[begin]) / chars
    tail = kinds[t.end - 1]
    initial = kinds[t.start]
    x[:, 8] = total(same) / n
    x[:, 9] = total(tail >= 6) / n  # words that end in a symbol or a non-ASCII byte
    x[:, 10] = total((initial == 6) & (tail == 6)) / n
    x[:, 11] = total(tail == 5) / n
    x[:, 12] = total(initial == 1) / n
    x[:, 13] = total(size) / n / 8
    x[:, 14] = np.sqrt(np.maximum(0, total(size ** 2) / n - (total(size) / n) ** 2)) / 8
    x[:, 15] = total(tail == 4) / n
    x[:, 16] = total(size <= 2) / n
    x[:, 17] = total(size >= 12) / n
    # distinct words of the passage: first occurrences by (passage, word)
    at = np.repeat(np.arange(len(n)), n.astype(np.int64))
    order = np.argsort(word ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    w, p = word[order], at[order]
    new = np.append(True, (w[1:] != w[:-1]) | (p[1:] != p[:-1]))
    x[:, 18] = np.bincount(p[new], minlength=len(n)) / n
    x[:, 19] = n / PASSAGE
    out[full] = x
    return out, first
