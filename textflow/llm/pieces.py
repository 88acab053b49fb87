"""Texts as runs of units that tokenize alone, each distinct unit once per Python worker.

A unit begins at a single space between other characters, and has that space.
No pre-token of the tokenizers here spans such a space, so a text's ids are
its units' ids one after another.  White space of any other kind stays inside
a unit.  Units are told apart by 64-bit hashes of their bytes.  What is known
of units outlives a task with its Python worker, and starts anew when there
are too many, which bounds a worker's memory; results do not depend on that.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from json import loads
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from textflow.llm import forget, give_back
from textflow.llm.words import RunHasher, chunks

#: Bytes of text whose new units are encoded together, and distinct units kept by a Python worker.
GROUP_BYTES, KEPT = 8 << 20, 1 << 20

_LAST = np.zeros(256, np.uint8)  # of a character before a space: 1 white, 2 perhaps
_LAST[[*range(9, 14), *range(28, 33)]] = 1
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = 2
_NEXT = np.zeros(256, np.uint8)  # of a character after a space
_NEXT[[*range(9, 14), *range(28, 33)]] = 1
_NEXT[[0xC2, 0xE1, 0xE2, 0xE3]] = 2


def _wide_white(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether bytes (a, b) and (a, b, c) are a white space character beyond ASCII."""
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
             | ((a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
             | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)))
    return two, three


def cuts(buf: np.ndarray) -> np.ndarray:
    """Positions of the single spaces between other characters.  ``buf`` ends,
    as every text in it, with a line feed."""
    at = np.flatnonzero(buf == 32)
    at = at[at > 0]
    last, nxt = _LAST[buf[at - 1]], _NEXT[buf[at + 1]]
    white = (last == 1) | (nxt == 1)
    look = np.flatnonzero(((last == 2) | (nxt == 2)) & ~white)
    if len(look):
        p, end = at[look], len(buf) - 1
        z, y, x = (buf[np.maximum(p - k, 0)] for k in (1, 2, 3))
        two, three = _wide_white(y, z, z)[0], _wide_white(x, y, z)[1]
        a, b, c = (buf[np.minimum(p + k, end)] for k in (1, 2, 3))
        two_on, three_on = _wide_white(a, b, c)
        white[look] = two | three | two_on | three_on
    return at[~white]


class Encoder:
    """Ids of texts.  ``encode``: list of units -> (flat ids, number of ids of each unit)."""

    def __init__(self, encode: Callable):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.hash, self.number, self.new = np.empty(0, np.uint64), np.empty(0, np.int32), []
        self.ids, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _numbers(self, values: list[bytes | None]) -> list[np.ndarray]:
        """The units of each text, by number."""
        values = [v or b"" for v in values]
        raw = b"\n".join(values) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        begin = np.append(0, np.cumsum([len(v) + 1 for v in values]))
        start = np.sort(np.append(begin[:-1], cuts(buf)))
        end = np.append(start[1:], len(buf))
        end[np.searchsorted(start, begin[1:]) - 1] -= 1
        found, one, at = np.unique(RunHasher(buf)(start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, found)
        known = np.zeros(len(found), bool)
        inside = place < len(self.hash)
        known[inside] = self.hash[place[inside]] == found[inside]
        number = np.empty(len(found), np.int32)
        number[known] = self.number[place[known]]
        fresh = np.flatnonzero(~known)
        number[fresh] = len(self.number) + np.arange(len(fresh))
        self.hash = np.insert(self.hash, place[fresh], found[fresh])
        self.number = np.insert(self.number, place[fresh], number[fresh])
        self.new += [raw[s:e].decode() for s, e in zip(start[one[fresh]].tolist(), end[one[fresh]].tolist())]
        return np.split(number[at], np.searchsorted(start, begin[1:-1]))

    def texts(self, column: pa.Array):
        """(first row, ids of each row as arrays) for runs of rows; null is an empty text."""
        rows, first, size = [], 0, 0
        for _, values in chunks(column):
            if not rows and len(self.number) > KEPT:
                self.clear()
            rows += self._numbers(values)
            size += sum(len(v or b"") for v in values)
            if size >= GROUP_BYTES or first + len(rows) == len(column):
                if self.new:
                    ids, n = self.encode(self.new)
                    self.ends, self.ids, self.new = np.append(self.ends, self.ends[-1] + np.cumsum(n)), np.append(self.ids, ids.astype(np.int32)), []
                for at in range(0, len(rows), 256):
                    yield first + at, [gather(self.ids, self.ends[r], self.ends[r + 1] - self.ends[r]) for r in rows[at:at + 256]]
                rows, first, size = [], first + len(rows), 0
                give_back()


def worker_encoder(key: str, make: Callable[[], Encoder]) -> Encoder:
    """The encoder that this Python worker keeps under ``key`` for its tasks."""
    forget("_textflow_margins")
    kept = sys.modules.setdefault("_textflow_encoders", SimpleNamespace()).__dict__
    if key not in kept:
        kept.clear()
        kept[key] = make()
    if len(kept[key].number) != len(kept[key].ends) - 1:  # a task ended between the two
        kept[key].clear()
    return kept[key]


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0] + n[0]], flat[start[1]:...], ... one after another."""
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start[0]:start[0] + n[0]], flat[start[1]:...], ... one after another."""
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def byte_level(json: str) -> str:
    """``json``, if single spaces end the pre-tokens of its tokenizer: its only
    pre-tokenizer is the byte-level one, and there is no normalizer."""
    said = loads(json)
    kind = said["pre_tokenizer"]
    if said["normalizer"] or kind["type"] != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex"):
        raise ValueError("units are cut at spaces only for the plain byte-level pre-tokenizer")
    return json


class Library:
    """Ids of units by the tokenizers library.  ``json``: its file's text.

    Units are handed over many at a time: those that begin with their space
    and end without white space, one after another, are again cut there by the
    library, and its offsets tell whose each id is."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(json)
        self.tokenizer.encode_special_tokens = True

    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def __call__(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        together = np.array([len(u) > 1 and u[0] == " " and not u[-1].isspace() for u in units], bool)
        joint, rest = np.flatnonzero(together), np.flatnonzero(~together)
        flat, counts = [np.empty(0, np.int32)], np.empty(len(units), np.int64)
        for low in range(0, len(joint), 1000):
            some = [units[i] for i in joint[low:low + 1000]]
            got = self.tokenizer.encode("".join(some), add_special_tokens=False)
            # an id belongs to the unit in which its characters end
            ends = np.array([b for _, b in got.offsets], np.int64)
            cut = np.searchsorted(ends, np.cumsum([0, *map(len, some)]), side="right")
            counts[joint[low:low + 1000]] = np.diff(cut)
            flat.append(np.array(got.ids, np.int32))
        for i, got in zip(rest, self.tokenizer.encode_batch([units[i] for i in rest], add_special_tokens=False)):
            counts[i] = len(got.ids)
            flat.append(np.array(got.ids, np.int32))
        order = np.concatenate([joint, rest])
        begin = np.empty(len(units), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return gather(np.concatenate(flat), begin, counts), counts
