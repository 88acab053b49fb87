"""Byte-level BPE by a rank queue with a hierarchical bitmap.

All new pre-tokens of a task lie in one linked list of byte positions, with an
end mark between pre-tokens.  A bucket per merge rank holds the positions
whose pair has that rank.  A bitmap of three levels of 64-bit words marks the
non-empty buckets; find-first-set gives the next rank.  Taking a bucket, stale
positions (merged away, or with another pair by now) are skipped, the rest are
merged, and the pairs that arise join their buckets.  A pre-token of any
length costs one step per merge.

Merges of one rank in one pre-token happen together where no pair that arises
can have a lower rank.  For the ranks where one can (careful ranks), the
leftmost of each pre-token is merged before the queue is asked again; a
pre-token that has many of them is gone through once from left to right, and
what lower ranks a merge brings up is merged before the next one.
"""

from __future__ import annotations

import base64
from functools import partial
from hashlib import sha256
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textflow.llm.pieces import Encoder, gather, lists, worker_encoder
from textflow.llm.stored import pick

#: Units merged in one queue, which bounds its memory; places of a careful rank in one pre-token from which on it is gone through.
TOGETHER, MANY = 1 << 17, 16

_NONE = np.iinfo(np.int32).max


class Bitmap:
    """Set of small integers; the least member in one step per level."""

    def __init__(self, n: int):
        self.levels = []
        while n > 1 or not self.levels:
            n = -(-n // 64)
            self.levels.append([0] * n)

    def add(self, x: int) -> None:
        for level in self.levels:
            word, bit = x >> 6, 1 << (x & 63)
            if level[word] & bit:
                return
            level[word] |= bit
            x = word

    def discard(self, x: int) -> None:
        for level in self.levels:
            word = x >> 6
            level[word] &= ~(1 << (x & 63))
            if level[word]:
                return
            x = word

    def least(self) -> int:
        """The least member, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            x = (x << 6) | ((word & -word).bit_length() - 1)
        return x


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, of a file with a base64 token and its rank a line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Merger:
    """Ids of pre-tokens under the merge ranks of ``tokens``."""

    def __init__(self, tokens: list[bytes]):
        self.n, self.rank = len(tokens), {t: r for r, t in enumerate(tokens) if t}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        self.careful = np.zeros(self.n, bool)  # ranks whose token ends or begins a token of lower rank
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * (self.n + 1) + right)
                    merged.append(rank)
                    self.careful[left] |= left > rank
                    self.careful[right] |= right > rank
        self.by_pair = dict(zip(keys, merged))
        by = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[by], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[by], _NONE)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * (self.n + 1) + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def units(self, split, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their number of each unit, a run of pre-tokens that ``split`` finds."""
        parts = [self._some(split, units[low:low + TOGETHER]) for low in range(0, len(units), TOGETHER)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _some(self, split, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number: dict[str, int] = {}
        parts = [[number.setdefault(p, len(number)) for p in split(u)] for u in units]
        flat, counts = self(list(number))
        ends = np.append(0, np.cumsum(counts))
        pieces = np.fromiter(chain.from_iterable(parts), np.int64)
        per = np.fromiter(map(len, parts), np.int64, len(parts))
        n = np.append(0, np.cumsum(counts[pieces]))
        cut = np.append(0, np.cumsum(per))
        return gather(flat, ends[pieces], counts[pieces]), n[cut[1:]] - n[cut[:-1]]

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each pre-token.  A pre-token that is a token is that token."""
        raw = [p.encode() for p in pieces]
        whole = np.fromiter((self.rank.get(p, -1) for p in raw), np.int64, len(raw))
        rest = np.flatnonzero(whole < 0)
        counts = np.ones(len(raw), np.int64)
        ids, counts[rest] = self.merge([raw[i] for i in rest])
        flat = np.empty(counts.sum(), np.int32)
        begin = np.cumsum(counts) - counts
        flat[begin[whole >= 0]] = whole[whole >= 0]
        inside = np.zeros(len(flat), bool)
        inside[begin[whole >= 0]] = True
        flat[~inside] = ids
        return flat, counts

    def _through(self, rank: int, places: np.ndarray, token: np.ndarray, nxt: np.ndarray, prv: np.ndarray, pair: np.ndarray, end: int) -> np.ndarray:
        """Merge the pairs of a careful rank at ascending places, and after
        each those of lower or equal rank that have come up, lowest and
        leftmost first (they are never right of it).  Returns the places of
        other new pairs."""
        known, width, new = self.by_pair, self.n + 1, []
        for place in places.tolist():
            heap = [(rank, place)]
            while heap:
                r, at = heappop(heap)
                if pair[at] != r:
                    continue
                right = int(nxt[at])
                after, before = int(nxt[right]), int(prv[at])
                token[at], token[right], pair[right] = r, -1, _NONE
                nxt[at], prv[after] = after, at
                for a, b in ((before, at), (at, after)):
                    found = known.get(int(token[a]) * width + int(token[b]), _NONE) if a != end and b != end else _NONE
                    if a != end:
                        pair[a] = found
                        if found <= rank:
                            heappush(heap, (found, a))
                        elif found != _NONE:
                            new.append(a)
        return np.unique(np.array(new, np.int32))

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        total = int(size.sum())
        piece = np.repeat(np.arange(len(raw), dtype=np.int32), size)
        end = total  # the mark that stands before the first and after the last of each pre-token
        token = np.append(self.byte[np.frombuffer(b"".join(raw), np.uint8)], self.n).astype(np.int32)
        nxt, prv = np.arange(1, total + 2, dtype=np.int32), np.arange(-1, total, dtype=np.int32)
        last = np.cumsum(size)
        nxt[last - 1], prv[last - size] = end, end
        nxt[end] = prv[end] = end
        queue, buckets = Bitmap(self.n), {}
        pair = self.pair_rank(token, token[nxt])

        def put(at: np.ndarray) -> None:
            at = at[pair[at] != _NONE]
            if not len(at):
                return
            by = pair[at]
            if len(at) > 1:
                order = np.argsort(by, kind="stable")
                at, by = at[order], by[order]
                cuts = np.flatnonzero(by[1:] != by[:-1]) + 1
                parts, ranks = np.split(at, cuts), by[np.append(0, cuts)].tolist()
            else:
                parts, ranks = [at], by.tolist()
            for rank, part in zip(ranks, parts):
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = [part]
                    queue.add(rank)
                else:
                    held.append(part)

        put(np.arange(total, dtype=np.int32))
        while (rank := queue.least()) >= 0:
            held = buckets.pop(rank)
            queue.discard(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if self.careful[rank]:
                at = np.sort(at)
                first = np.append(True, piece[at[1:]] != piece[at[:-1]])
                number = np.cumsum(first) - 1
                many = np.bincount(number)[number] >= MANY
                if many.any():
                    put(self._through(rank, at[many], token, nxt, prv, pair, end))
                    at, first = at[~many], first[~many]
                    if not len(at):
                        continue
                if not first.all():
                    buckets[rank] = [at[~first]]
                    queue.add(rank)
                    at = at[first]
            elif len(at) > 1 and token[at[0]] == token[nxt[at[0]]]:  # a pair of equals may overlap the next one
                at = np.sort(at)
                joined = np.append(False, nxt[at[:-1]] == at[1:])
                index = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(joined, 0, index))
                at = at[(index - begin) % 2 == 0]
            right = nxt[at]
            after = nxt[right]
            token[at] = rank
            token[right] = -1
            pair[right] = _NONE
            nxt[at] = after
            prv[after] = at
            before = prv[at]
            pair[at] = self.pair_rank(token[at], token[nxt[at]])
            pair[before] = self.pair_rank(token[before], token[nxt[before]])
            pair[end] = _NONE
            put(np.unique(np.concatenate([at, before])))
        left = token[:total] >= 0
        return token[:total][left], np.bincount(piece[left], minlength=len(raw))


class Bytes:
    """Bytes of ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64)
        self.flat, self.begin = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> bytes:
        return gather(self.flat, self.begin[ids], self.size[ids]).tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_bytes: bool = False) -> DataFrame:
    """(id_col, ids array<int>) of every row: each match of ``pattern`` is
    encoded by the merge ranks of the file.  ``with_bytes``: also the bytes to
    which the ids are decoded, in the same task.  Null and empty texts have no ids.
    Ids, null or repeated ones too, are passed through.  The file is read by
    the driver; its size is that of the vocabulary."""
    rows = pick(docs, {"id": id_col, "text": text_col})
    ranks = read_ranks(ranks_path)
    tokens, key = docs.sparkSession.sparkContext.broadcast(ranks), sha256(b"\n".join(ranks)).hexdigest()

    def run(batches):
        split = regex.compile(pattern).findall
        coder = worker_encoder(f"{key} {pattern}", lambda: Encoder(partial(Merger(tokens.value).units, split)))
        back = Bytes(tokens.value) if with_bytes else None
        for batch in batches:
            for low, ids in coder.texts(batch["text"]):
                columns = {"id": batch["id"].slice(low, len(ids)), "ids": lists(ids, pa.int32())}
                if back:
                    columns["bytes"] = pa.array([back(x) for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return (rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>" + ", bytes binary" * with_bytes)
            .withColumnRenamed("id", id_col))


def decode(coded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``coded`` with the bytes of its ids.  Null ids give null."""
    tokens = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = StructType([*coded.schema.fields]).add(out_col, "binary")

    def run(batches):
        back = Bytes(tokens.value)
        for batch in batches:
            column = batch[ids_col]
            out = []
            for i in range(len(column)):
                ids = column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else None
                out.append(None if ids is None else back(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    return coded.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of an encoding round trip."""
    coded = encode(docs, ranks_path, pattern, with_bytes=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("bytes", 256).alias("decoded_sha256"))
