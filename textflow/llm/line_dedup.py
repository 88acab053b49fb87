"""Line dedup by sharded minimal perfect hashes.

Lines are told apart by 128-bit digests of their keys.  What the corpus says
of a line (in how many documents it stands, and which is the last of them) is
added up by digest, in every task first, so a line that very many documents
hold costs one row a batch.  The distinct digests that enough documents hold
are dealt by hash into shards of bounded size.  A shard is a minimal perfect
hash and three arrays that it indexes: fingerprints (the half of the digest
that does not choose the shard), counts and keepers.

Documents probe the arrays; no line is joined to another.  Arrays of at most
BROADCAST_BYTES in all go to every task, and one pass over the documents
probes them.  Beyond that, digests travel to the shards: a task reads each of
its shards' arrays, then the digests dealt to it, one batch after another, so
it holds one shard at a time, and a shard that many digests probe is copied
to several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.llm.perfect_hash import PerfectHash
from textflow.llm.stored import bounded_batches, discard, pick, store
from textflow.llm.words import chunks

#: Digests of a shard, about, and the bytes of arrays that every task may be sent.
SHARD_KEYS, BROADCAST_BYTES = 1 << 16, 32 << 20
#: Probes of a shard, about, that one task answers in the second way.
SHARD_PROBES = 1 << 21

_BLANK = b" \t\n\x0b\x0c\r"
_ARRAYS = "shard int, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"
_PROBE = "shard int, part int, kind int, key long, at binary, digests binary, sizes binary, words binary, fingerprints binary, counts binary, keepers binary"


def line_key(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()  # bytes.lower changes A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.decode()) >= least)


def digests(values: list[bytes | None], least: int):
    """(lines of each text, its line numbers with a key of at least ``least`` code points, their digests)."""
    for value in values:
        lines = (value or b"").split(b"\n")
        at, found = [], []
        for i, line in enumerate(lines):
            if len(line) >= least and _long_enough(key := line_key(line), least):
                at.append(i)
                found.append(xxhash.xxh3_128_digest(key))
        yield lines, np.array(at, np.int32), np.frombuffer(b"".join(found), np.uint64).reshape(-1, 2)


def _tally(least: int):
    """Per batch and digest: in how many of its rows it stands, and the largest id."""

    def run(batches):
        for batch in batches:
            ids, held = batch["id"].to_pylist(), {}
            for low, values in chunks(batch["text"]):
                for i, (_, _, d) in enumerate(digests(values, least)):
                    doc = ids[low + i]
                    for k in {row.tobytes() for row in d}:
                        n, last = held.get(k, (0, None))
                        held[k] = n + 1, doc if last is None else last if doc is None else max(last, doc)
            if held:
                d = np.frombuffer(b"".join(held), np.int64).reshape(-1, 2)
                n, last = zip(*held.values())
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(n, pa.int64()), pa.array(last, pa.int64())], ["one", "two", "n", "keeper"])

    return run


def _pack(key, table):
    """A shard of its digests, counts and keepers."""
    column = {c: table[c].to_numpy() for c in ("one", "two", "n", "keeper")}
    one, two = column["one"].view(np.uint64), column["two"].view(np.uint64)
    hashed = PerfectHash.of(one, two)
    at = hashed.find(one, two)
    arrays = []
    for values in (two, column["n"], column["keeper"]):
        out = np.empty_like(values)
        out[at] = values
        arrays.append(out.tobytes())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in (hashed.sizes.tobytes(), hashed.words.tobytes(), *arrays)]],
                    names=["shard", "sizes", "words", "fingerprints", "counts", "keepers"])


@dataclass
class Shard:
    hashed: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def read(cls, row: dict) -> Shard:
        return cls(PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64)),
                   np.frombuffer(row["fingerprints"], np.uint64), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["keepers"], np.int64))

    def look_up(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, keeper) of each digest; count 0 for one that is not in the shard."""
        at = self.hashed.find(digests[:, 0], digests[:, 1])
        known = (at >= 0) & (self.fingerprints[at] == digests[:, 1])
        return np.where(known, self.counts[at], 0), np.where(known, self.keepers[at], 0)


def shard_of(digests: np.ndarray, shards: int) -> np.ndarray:
    return digests[:, 0].view(np.int64) % shards  # as pmod in SQL


def line_shards(docs: DataFrame, least: int, min_docs: int) -> tuple[DataFrame, int]:
    """(shard, sizes, words, fingerprints, counts, keepers) of all lines that at
    least ``min_docs`` rows of ``docs`` (id, text) hold, written, and the number of shards."""
    said = docs.mapInArrow(_tally(least), "one long, two long, n long, keeper long")
    held = store(said.groupBy("one", "two").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
                 .where(F.col("n") >= min_docs).where("keeper is not null"), "lines")
    shards = max(1, -(-held.count() // SHARD_KEYS))
    out = store(held.withColumn("shard", F.pmod("one", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_pack, _ARRAYS), "line-shards")
    discard(held)
    return out, shards


def _finish(out: list) -> pa.RecordBatch:
    ids, n, dropped, kept = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                                       pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_lines", "n_dropped", "kept"])


_RESULT = "id long, n_lines long, n_dropped long, kept string"


def _without(lines: list[bytes], drop: np.ndarray) -> bytes:
    gone = set(drop.tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone)


def _everywhere(docs: DataFrame, arrays: list, shards: int, least: int) -> DataFrame:
    """All documents by arrays that every task is sent."""
    sent = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in arrays])

    def run(batches):
        table = {r["shard"]: Shard.read(r) for r in sent.value}
        for batch in batches:
            ids = batch["id"].to_pylist()
            for low, values in chunks(batch["text"]):
                rows = list(digests(values, least))
                every = np.concatenate([d for _, _, d in rows])
                whose, last = shard_of(every, shards), np.empty(len(every), np.int64)
                count = np.zeros(len(every), np.int64)
                for s in np.unique(whose):
                    if s in table:
                        here = np.flatnonzero(whose == s)
                        count[here], last[here] = table[s].look_up(every[here])
                out, begin = [], 0
                for doc, (lines, at, d) in zip(ids[low:low + len(rows)], rows):
                    c, k = count[begin:begin + len(at)], last[begin:begin + len(at)]
                    begin += len(at)
                    gone = at[(c > 0) & (k != doc)] if doc is not None else at[c > 0]
                    out.append((doc, len(lines), len(gone), _without(lines, gone) if len(gone) else b"\n".join(lines)))
                yield _finish(out)

    return docs.mapInArrow(run, _RESULT)


def _by_shard(docs: DataFrame, arrays: DataFrame, shards: int, least: int) -> DataFrame:
    """All documents, their digests sent to the shards."""
    keyed = store(docs.withColumn("key", F.monotonically_increasing_id()), "keyed")

    def send(batches):
        for batch in batches:
            keys = batch["key"].to_numpy()
            for low, values in chunks(batch["text"]):
                out = []
                for i, (_, at, d) in enumerate(digests(values, least)):
                    whose = shard_of(d, shards)
                    out += [(int(s), int(keys[low + i]), at[whose == s].tobytes(), d[whose == s].tobytes()) for s in np.unique(whose)]
                if out:
                    s, k, a, d = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int64()), pa.array(a, pa.binary()), pa.array(d, pa.binary())], ["shard", "key", "at", "digests"])

    probes = store(keyed.mapInArrow(send, "shard int, key long, at binary, digests binary"), "probes")
    total = probes.agg(F.sum(F.length("at"))).first()[0] or 0
    parts = max(1, -(-total // 4 // shards // SHARD_PROBES))
    empty = [F.lit(None).cast("binary").alias(c) for c in ("sizes", "words", "fingerprints", "counts", "keepers")]
    asked = probes.select("shard", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "key", "at", "digests", *empty)
    told = arrays.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("key"),
                         F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("digests"), "sizes", "words", "fingerprints", "counts", "keepers")

    def answer(batches):
        have, shard = None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    have, shard = (r["shard"], r["part"]), Shard.read(r)
                elif have == (r["shard"], r["part"]):
                    n, last = shard.look_up(np.frombuffer(r["digests"], np.uint64).reshape(-1, 2))
                    at = np.frombuffer(r["at"], np.int32)
                    if (n > 0).any():
                        out.append((r["key"], at[n > 0].tolist(), last[n > 0].tolist()))
            if out:
                key, at, last = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int64()))], ["key", "at", "keepers"])

    found = (told.union(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
             .mapInArrow(answer, "key long, at array<int>, keepers array<long>"))
    marked = found.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("keepers")).alias("keepers"))  # a document's own lines

    def drop(batches):
        for batch in batches:
            ids, at, last = batch["id"].to_pylist(), batch["at"].to_pylist(), batch["keepers"].to_pylist()
            for low, values in chunks(batch["text"]):
                out = []
                for i, value in enumerate(values, low):
                    lines = (value or b"").split(b"\n")
                    gone = np.array([a for a, k in zip(at[i] or [], last[i] or []) if k != ids[i]], np.int32)
                    out.append((ids[i], len(lines), len(gone), _without(lines, gone)))
                yield _finish(out)

    return keyed.join(marked, "key", "left").select("id", "text", "at", "keepers").mapInArrow(drop, _RESULT)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, min_docs: int = 5,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Texts without the lines that ``min_docs`` documents or more share.

    A line's key is the line without x20 and x09-x0D at both ends, A-Z
    lower-cased.  Keys of at least ``least`` code points found in at least
    ``min_docs`` documents lose all their lines except in the document with
    the largest id that holds it.  Returns per row: (id_col, n_lines,
    n_dropped, kept), ``kept`` the other lines joined by line feeds.

    A null or empty text is one empty line.  Every row is a document: rows
    that repeat an id count one by one, and each with the largest id keeps its
    lines.  A row without an id counts too, but never keeps; lines that only
    rows without an id hold stay.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    arrays, shards = line_shards(rows, least, min_docs)
    size = arrays.agg(F.sum(sum(F.length(c) for c in ("sizes", "words", "fingerprints", "counts", "keepers")))).first()[0] or 0
    found = _everywhere(rows, arrays.collect(), shards, least) if size <= broadcast_bytes else _by_shard(rows, arrays, shards, least)
    return found.withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def report_sql() -> str:
    """DuckDB SQL for :func:`report`."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{upper.lower()}') AS key FROM line),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key
           HAVING count(DISTINCT rid) >= 5 AND max(doc_id) IS NOT NULL),
marked AS (SELECT rid, k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone
           FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
