"""Best-fit packing of token sequences by linear grouping.

Lengths are small integers, so how many pieces have each length decides the
packing; it is worked out on that histogram, whose size does not grow with
the corpus.  Large lengths are sorted and cut into groups of equal
cardinality, and each is rounded up to the largest of its group.  The few
rounded sizes are packed by configurations (what one sequence holds): a linear
program over configurations, made by column generation, rounded down, and the
few sizes left over packed best-fit.  Actual lengths then take the places of
their group's size, longest first, and the small lengths go best-fit into the
room that is left.  The plan is a table of runs of equal sequences; each piece
finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textflow.llm.pieces import Encoder, Library, byte_level, lists, worker_encoder
from textflow.llm.stored import pick, store

#: Lengths of at least this share of a sequence are large; groups of large lengths.
SMALL_SHARE, GROUPS = 1 / 4, 512
#: Pieces of one length that one task ranks.
RANKED = 200_000


def group_sizes(histogram: np.ndarray, least: int, groups: int) -> list[tuple[int, int]]:
    """(rounded size, number of pieces) of the groups of the lengths from ``least`` on, of about equal cardinality, longest first."""
    lengths = [x for x in range(len(histogram) - 1, least - 1, -1) if histogram[x]]
    each = max(1, -(-int(histogram[least:].sum()) // groups))
    out: list[tuple[int, int]] = []
    top, n = 0, 0
    for x in lengths:
        top = top or x
        n += int(histogram[x])
        if n >= each:
            out.append((top, n))
            top, n = 0, 0
    if n:
        out.append((top, n))
    return out


def _price(sizes: list[int], value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration: unbounded knapsack."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    order = [i for i in range(len(sizes)) if value[i] > 1e-12]
    size, worth = np.array([sizes[i] for i in order], np.int64), np.array([value[i] for i in order])
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fits = size <= c
        if fits.any():
            total = np.where(fits, best[np.maximum(c - size, 0)] + worth, -1.0)
            k = int(total.argmax())
            if total[k] > best[c] + 1e-12:
                best[c], take[c] = total[k], order[k]
    found, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            found[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), found


def configurations(groups: list[tuple[int, int]], room: int, rounds: int = 300) -> list[tuple[np.ndarray, int]]:
    """(pieces of each group in one sequence, number of such sequences):
    whole multiples of a solution of the linear program.  Columns come from a
    best-fit packing of the rounded sizes, then from pricing; ``rounds``
    bounds the pricing steps (a solution stopped there is valid, if longer)."""
    if not groups:
        return []
    sizes, demand = [s for s, _ in groups], np.array([n for _, n in groups], float)
    m = len(sizes)
    first = Loads(room)
    for s, n in groups:
        first.best_fit(s, n)
    pool = np.array([[content.get(s, 0) for s in sizes] for _, content in first.runs()], np.int64)
    basis = np.diag([room // s for s in sizes])
    inverse, amount = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    pivots = 0
    for _ in range(rounds):
        while True:
            dual = inverse.sum(axis=0)
            gain = pool @ dual
            column = pool[int(gain.argmax())]
            if gain.max() <= 1 + 1e-7 or pivots > 20 * m + 100 * rounds:
                break
            change = inverse @ column
            ratio = np.where(change > 1e-9, amount / np.maximum(change, 1e-9), np.inf)
            out = int(ratio.argmin())
            amount = np.maximum(amount - ratio[out] * change, 0.0)
            amount[out] = ratio[out]
            basis[:, out] = column
            row = inverse[out] / change[out]
            inverse -= np.outer(change, row)
            inverse[out] = row
            pivots += 1
            if pivots % 100 == 0:
                inverse = np.linalg.inv(basis)
                amount = np.maximum(inverse @ demand, 0.0)
        worth, column = _price(sizes, dual, room)
        if worth <= 1 + 1e-5:
            break
        pool = np.vstack([pool, column])
    return [(basis[:, j].astype(np.int64), int(amount[j] + 1e-6)) for j in range(m) if amount[j] + 1e-6 >= 1]


class Loads:
    """Runs of equal sequences, by the room each has left."""

    def __init__(self, room: int):
        self.room, self.by_left, self.lefts = room, {}, []

    def add(self, times: int, content: dict[int, int]) -> None:
        left = self.room - sum(x * k for x, k in content.items())
        if left not in self.by_left:
            self.by_left[left] = []
            insort(self.lefts, left)
        self.by_left[left].append((times, content))

    def best_fit(self, x: int, n: int) -> None:
        """``n`` pieces of length ``x``, each into the fullest sequence that has
        room.  A sequence with room for several is again the fullest."""
        while n:
            at = bisect_left(self.lefts, x)
            if at == len(self.lefts):
                times, content, left = -(-n // (self.room // x)), {}, self.room
            else:
                left = self.lefts[at]
                times, content = self.by_left[left].pop()
                if not self.by_left[left]:
                    del self.by_left[left], self.lefts[at]
            each = left // x
            whole = min(times, n // each)
            if whole:
                self.add(whole, {**content, x: content.get(x, 0) + each})
                n -= whole * each
                times -= whole
            if times and n:  # n < each
                self.add(1, {**content, x: content.get(x, 0) + n})
                n, times = 0, times - 1
            if times and content:
                self.add(times, content)

    def runs(self) -> list[tuple[int, dict[int, int]]]:
        return [run for left in self.lefts for run in self.by_left[left]]


def _take(own: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` lengths of a group as (length, count)."""
    out = []
    while n:
        k = min(n, own[0][1])
        out.append((own[0][0], k))
        n -= k
        own[0][1] -= k
        if not own[0][1]:
            own.pop(0)
    return out


def plan(histogram: np.ndarray, room: int, groups: int = GROUPS) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces of it in each}), together the
    histogram.  ``histogram[x]``: pieces of length x, 0 < x <= room."""
    left, loads = np.array(histogram, np.int64), Loads(room)
    if left[room]:
        loads.add(int(left[room]), {room: 1})
        left[room] = 0
    least = max(1, int(room * SMALL_SHARE))
    grouped, stock, x = group_sizes(left, least, groups), [], room
    for _, n in grouped:
        own: list[list[int]] = []
        while n:
            if left[x]:
                own.append([x, int(left[x])])
                n -= int(left[x])
            x -= 1
        stock.append(own)
    for config, times in configurations(grouped, room):
        slots = [g for g, k in enumerate(config) for _ in range(k)]
        have = Counter({g: sum(n for _, n in stock[g]) for g in set(slots)})
        times = min([times, *(have[g] // k for g, k in Counter(slots).items())])
        columns = [_take(stock[g], times) for g in slots]  # each slot's actual lengths down the sequences
        while times:
            step = min(c[0][1] for c in columns)
            loads.add(step, dict(Counter(c[0][0] for c in columns)))
            columns = [([(c[0][0], c[0][1] - step)] if c[0][1] > step else []) + c[1:] for c in columns]
            times -= step
    for own in stock:
        for x, n in own:
            loads.best_fit(x, n)
    for x in range(least - 1, 0, -1):
        loads.best_fit(x, int(left[x]))
    return loads.runs()


def places(runs: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """By (length, first rank): from that rank on, the pieces of the length go
    ``each`` to a sequence, from sequence ``sequence`` on, from ``offset`` on."""
    rows, seen, sequence = [], Counter(), 0
    for times, content in runs:
        offset = 0
        for x, k in sorted(content.items(), reverse=True):
            rows.append((x, seen[x], k, sequence, offset))
            seen[x] += times * k
            offset += x * k
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T))


def pack(pieces: DataFrame, room: int, order: list[str], length_col: str = "length") -> DataFrame:
    """``pieces`` with (sequence_id, offset): where each lies in sequences of
    at most ``room`` tokens, without gaps from offset 0.

    ``pieces`` has a length from 1 to ``room`` in every row and should be a
    stored table, as it is read three times; ``order``: columns that tell its
    rows apart (rows equal in them may swap places).  Other columns are kept.
    A length that is null or out of range is an error.  Equal lengths fill
    their places in the order of a hash, so a hot length is spread over tasks.
    No rows, no sequences."""
    rows = pieces.groupBy(length_col).agg(F.count(F.lit(1)).alias("n")).collect()  # room rows at most
    histogram = np.zeros(room + 1, np.int64)
    for r in rows:
        if r[0] is None or not 0 < r[0] <= room:
            raise ValueError(f"{length_col} must be from 1 to {room}, not {r[0]}")
        histogram[r[0]] = r.n
    place = places(plan(histogram, room))
    most = max(1000, int(histogram.sum() ** 0.5))
    parts = F.array(*[F.lit(int(max(1, -(-n // most)))) for n in histogram])
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.element_at(parts, F.col(length_col).cast("int") + 1)))
    sizes = keyed.groupBy(length_col, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy(length_col, "_part").orderBy(*order)) - 1)
    ranked = ranked.join(sizes, [length_col, "_part"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    big = int(histogram.sum()) + 1
    starts = place["length"] * big + place["rank"]

    def run(batches):
        for batch in batches:
            length = batch[length_col].to_numpy().astype(np.int64)
            at = np.searchsorted(starts, length * big + batch["_rank"].to_numpy(), side="right") - 1
            nth = batch["_rank"].to_numpy() - place["rank"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(place["sequence"][at] + nth // place["each"][at]),
                 pa.array(place["offset"][at] + nth % place["each"][at] * length)],
                [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long"))


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, room: int, id_col: str = "doc_id", text_col: str = "text",
        keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``room`` of every row's text and end id:
    (id_col, piece, start, length, ids_crc32), with ``keep_ids`` also ids.

    Only longer documents are cut, into pieces of ``room`` but for the first.
    A null or empty text has its end id alone.  Repeated and null ids are kept
    as they are.  ids_crc32 is that of the ids as little-endian unsigned
    32-bit integers."""
    rows = pick(docs, {"id": id_col, "text": text_col})
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(byte_level(f.read()))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        coder = worker_encoder(json.value, lambda: Encoder(Library(json.value)))
        for batch in batches:
            for low, found in coder.texts(batch["text"]):
                which, starts, sizes, sums, kept = [], [], [], [], []
                for i, ids in enumerate(found):
                    ids = np.append(ids, np.int32(end_id)).astype("<u4")
                    begin, stop = 0, len(ids) % room or room
                    while begin < len(ids):
                        which.append((low + i, len(starts)) if not begin else (low + i, None))
                        part = ids[begin:stop]
                        starts.append(begin)
                        sizes.append(len(part))
                        sums.append(zlib.crc32(part.tobytes()))
                        if keep_ids:
                            kept.append(part.astype(np.int32))
                        begin, stop = stop, stop + room
                row = np.array([w for w, _ in which])
                first = np.maximum.accumulate([-1 if f is None else f for _, f in which])
                columns = {"id": batch["id"].take(pa.array(row)), "piece": pa.array(np.arange(len(row)) - first, pa.int32()),
                           "start": pa.array(starts, pa.int64()), "length": pa.array(sizes, pa.int64()),
                           "ids_crc32": pa.array(sums, pa.int64())}
                if keep_ids:
                    columns["ids"] = lists(kept, pa.int32())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, room: int) -> DataFrame:
    """Pieces of all documents with their place in as few sequences as the method finds."""
    pieces = store(cut(docs, tokenizer_path, end_id, room), "pieces")
    return pack(pieces, room, ["doc_id", "piece", "ids_crc32"])
