"""Token ids in byte-aligned variable-length files.

Ids are numbered by falling frequency.  A number takes one to four bytes; the
lengths stand apart in control bytes, two bits a number, four numbers a byte.
Decoding is a table lookup by control byte, for a whole block at once.

A file set is a folder with two Parquet tables, so that any store that Spark
reads can hold it and a task that is lost leaves no half file: ``ranks`` (one
row: the id of every rank) and ``blocks`` (part, first, n_ids, doc_ids, sizes,
control, data).  Parts ascend by document id; ``first`` counts the ids before
a block in its part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.llm.pieces import Encoder, Library, lists, worker_encoder
from textflow.llm.stored import new_path, pick, store

#: Ids in a block, about, and bytes of text in a part.
BLOCK_IDS, PART_BYTES = 1 << 18, 128 << 20

#: For each control byte the bytes of its four numbers.
_WIDTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def squeeze(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned numbers below 2^32."""
    x = numbers.astype("<u4")
    code = (x >= 1 << 8).astype(np.uint8) + (x >= 1 << 16) + (x >= 1 << 24)
    padded = np.zeros(-(-len(x) // 4) * 4, np.uint8)
    padded[:len(x)] = code
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    used = np.arange(4) <= code[:, None]
    return control.astype(np.uint8).tobytes(), x.view(np.uint8).reshape(-1, 4)[used].tobytes()


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of (control, data)."""
    width = _WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < width[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def _add(key, table):
    total = sum((np.frombuffer(x, np.int64) for x in table["ids"].to_pylist()), np.zeros(1, np.int64))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([total.tobytes()], pa.binary())})


def _bounds(rows: DataFrame) -> list[int]:
    """Upper ends of all parts but the last, by document id."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    cuts = [(i + 1) / parts for i in range(parts - 1)]
    return (rows.agg(F.percentile_approx("id", cuts, 20 * parts)).first()[0] or []) if cuts else []


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's text, append ``end_id``, and write all ids to ``path``
    in ascending order of ``id_col`` (null ids first; rows of one id in any order).

    A null or empty text has its end id alone.  An empty table gives a file
    set without blocks.  Rows of one id, however many, are spread over the
    parts that the id spans."""
    rows = pick(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("long"))
    bounds = np.array(_bounds(rows), np.int64)
    with open(tokenizer_path, encoding="utf-8") as f:
        json = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches):
        coder = worker_encoder(json.value, lambda: Encoder(Library(json.value)))
        size = coder.encode.size()
        kind, counts = "<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4", np.zeros(max(size, end_id + 1), np.int64)
        for batch in batches:
            for low, found in coder.texts(batch["text"]):
                found = [np.append(ids, np.int32(end_id)) for ids in found]
                counts += np.bincount(np.concatenate(found), minlength=len(counts))
                ids = batch["id"].slice(low, len(found))
                at = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                left, right = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
                spread = np.array([zlib.crc32(x.tobytes()) for x in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((left + spread % (right - left + 1)).astype(np.int32)), ids,
                     pa.array([x.astype(kind).tobytes() for x in found], pa.binary())], ["part", "id", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([counts.tobytes()], pa.binary())],
                                         ["part", "id", "ids"])

    coded = store(rows.mapInArrow(encode, "part int, id long, ids binary"), "coded")
    total = coded.where("part < 0").groupBy("part").applyInArrow(_add, "part int, ids binary").first()  # one count for each id
    counts = np.frombuffer(total.ids, np.int64) if total else np.zeros(1, np.int64)
    by_rank = np.argsort(-counts, kind="stable")
    docs.sparkSession.createDataFrame([(by_rank.tolist(),)], "ids array<int>").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.empty(len(counts), np.uint32)
    rank[by_rank] = np.arange(len(counts))
    kind = "<u2" if len(counts) <= 1 << 16 else "<u4"
    names = ["part", "first", "n_ids", "doc_ids", "sizes", "control", "data"]

    def block(part, first, ids, held):
        numbers = np.concatenate(held)
        control, data = squeeze(numbers)
        columns = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(numbers)], pa.int64()),
                   pa.array([ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int32())),
                   pa.array([control], pa.binary()), pa.array([data], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def blocks(batches):
        part, first, size, ids, held = None, 0, 0, [], []
        for batch in batches:
            for p, i, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p != part or size >= BLOCK_IDS):
                    yield block(part, first, ids, held)
                    first, size, ids, held = first + size, 0, [], []
                if p != part:
                    part, first = p, 0
                held.append(rank[np.frombuffer(raw, kind)])
                ids.append(i)
                size += len(held[-1])
        if held:
            yield block(part, first, ids, held)

    ordered = coded.where("part >= 0").repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "id")
    (ordered.mapInArrow(blocks, "part int, first long, n_ids long, doc_ids array<long>, sizes array<int>, control binary, data binary")
     .write.parquet(f"{path}/blocks"))


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a file set, with ``keep_ids`` also ids.

    start: ids of all documents before it; ids_crc32: that of its ids as
    little-endian unsigned 32-bit integers."""
    files = spark.read.parquet(f"{path}/blocks")
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each part
    before, seen = {}, 0
    for part in sorted(totals):
        before[part] = seen
        seen += totals[part]
    by_rank = np.array(spark.read.parquet(f"{path}/ranks").first().ids, np.uint32)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = by_rank[expand(r["control"], r["data"], r["n_ids"])].astype("<u4")
                size = np.array(r["sizes"], np.int64)
                end = np.cumsum(size)
                each = np.split(ids, end[:-1])
                columns = {"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(before[r["part"]] + r["first"] + end - size),
                           "n_tokens": pa.array(size), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())}
                if keep_ids:
                    columns["ids"] = lists([x.astype(np.int32) for x in each], pa.int32())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return files.mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the token files of all documents into the shared folder and read them back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(docs, tokenizer_path, end_id, path)
    return read_tokens(spark, path, keep_ids=False)
