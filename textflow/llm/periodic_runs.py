"""Periodic runs of words by internal pattern matching (:mod:`textflow.llm.repeats`).

Texts of a task are handled about a megabyte at a time, the words of all of
them as one sequence of numbers with an end mark after each text; a longer
text is handled alone.  Texts need nothing from one another, so there is no
shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm.pieces import gather
from textflow.llm.repeats import runs
from textflow.llm.stored import bounded_batches, pick
from textflow.llm.words import RunHasher, chunks, texts

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = "id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word order of the report: of one document in ten (by the id's
    crc32) the words from place a on are replaced by repetitions of the p
    words from a on.  None: the words stay."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i < a, i, a + (i - a) % p)


def _find(values: list[bytes | None], ids: list, order: Callable | None, least: int, times: int):
    """Of each text the number of words, (start, length, period) of its runs, and the words that no repetition dropped."""
    t = texts(values)
    n = np.diff(t.first)
    source = np.arange(len(t.start))
    if order:
        for i, doc_id in enumerate(ids):
            new = order(doc_id, int(n[i]))
            if new is not None:
                source[t.first[i]:t.first[i + 1]] = t.first[i] + new
    start, end = t.start[source], t.end[source]
    marks = t.first[1:] + np.arange(len(n))  # where each text's end mark stands
    s = np.empty(len(start) + len(n), np.int64)
    word = np.ones(len(s), bool)
    word[marks] = False
    s[word] = np.unique(RunHasher(t.buf)(t.start, t.end), return_inverse=True)[1][source] if len(start) else 0
    s[marks] = len(start) + np.arange(len(n))
    low, high, period = runs(s, int(n.max(initial=0)), least, times)
    begin = t.first[:-1] + np.arange(len(n))
    whose = np.searchsorted(marks, low)
    change = np.zeros(len(s) + 1, np.int64)
    np.add.at(change, low + period, 1)
    np.add.at(change, high, -1)
    kept = (np.cumsum(change[:-1]) == 0)[word]
    size = (end - start + 1)[kept]  # with the byte after each word
    flat = gather(t.buf, start[kept], size)
    flat = flat.copy() if len(flat) else np.zeros(0, np.uint8)
    flat[np.cumsum(size) - 1] = 32
    ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))))]
    cut = np.searchsorted(whose, np.arange(len(n) + 1))
    raw = flat.tobytes()
    for i in range(len(n)):
        mine = slice(cut[i], cut[i + 1])
        found = zip((low[mine] - begin[i]).tolist(), (high[mine] - low[mine]).tolist(), period[mine].tolist())
        yield int(n[i]), list(found), raw[ends[i]:max(ends[i], ends[i + 1] - 1)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4,
                  order: Callable | None = None) -> DataFrame:
    """Runs of words `[^\\x20\\x09-\\x0D]+` in every whole text, and the text without its repetitions.

    A run is a stretch of consecutive words whose smallest period q repeats at
    least ``times`` (4 or more) times, of at least ``least`` words, that no
    neighbouring word extends.  Returns per row: (id_col, n_words, runs,
    collapsed): the runs by start and period, words counted from 0, and the
    words that no run has after its first q words, joined by single spaces.
    ``order``: (id, number of words) -> which word stands at each place, or
    None where they stay.

    Null, empty and blank texts have no words and no runs.  Ids, null or
    repeated ones too, are passed through; repeated rows are rows of their own.
    Words are compared by 64-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    rows = pick(docs, {"id": id_col, "text": text_col})

    def run(batches):
        for batch in batches:
            ids = batch["id"].to_pylist()
            for low, values in chunks(batch["text"]):
                some = batch["id"].slice(low, len(values))
                n, found, kept = zip(*_find(values, ids[low:low + len(values)], order, least, times))
                found = [[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in found]
                yield pa.RecordBatch.from_arrays([some, pa.array(n, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())],
                                                 ["id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, _RESULT.format(rows.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) of every document, words ordered by :func:`repeated_tail`."""
    found = periodic_runs(docs, order=repeated_tail)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    line = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.expr(line).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
