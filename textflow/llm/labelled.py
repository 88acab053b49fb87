"""Labelled rows for a classifier: which may be learned from, and how many; and the scores of all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from textflow.llm import forget, give_back
from textflow.llm.stored import bounded_batches, pick, store
from textflow.llm.words import chunks


def held_out(id_col: str = "doc_id"):
    """True for the rows that no classifier learns from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, bytes_each: int) -> list:
    """(text, label) rows to learn from: of each label 0 and 1 at most
    ``per_class`` documents that are not held out, chosen by a hash of the id,
    none longer than ``bytes_each`` bytes; so at most 2 * per_class *
    bytes_each bytes come to the driver.  Rows without id, label or words, and
    documents labelled both ways, teach nothing."""
    known = (labels.select(F.col("doc_id"), F.col(f"`{label}`").alias("y")).where("doc_id is not null and y in (0, 1)")
             .where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most"))
    fits = docs.where(F.octet_length("text").between(1, bytes_each)).select("doc_id")
    pool = store(fits.join(known.select("doc_id", "y"), "doc_id").distinct().withColumn("by", F.xxhash64("doc_id")), "labelled")
    sizes = {r.y: r.n for r in pool.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen: dict[int, int] = {}
    for y, n in sizes.items():
        # so few hashes lie below the bound that the rest need not be compared
        bound = min(int((per_class + 5 * per_class ** 0.5 + 10) / n * 2 ** 64) - 2 ** 63, 2 ** 63 - 1)
        rows = pool.where((F.col("y") == y) & (F.col("by") <= F.lit(bound))).orderBy("by").limit(per_class).select("doc_id").collect()
        chosen.update((r.doc_id, y) for r in rows)
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], docs.select("doc_id").schema)  # 2 * per_class at most
    texts = docs.where(F.octet_length("text").between(1, bytes_each)).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return sorted((r.text, chosen[r.doc_id]) for r in texts.collect())


def judged(docs: DataFrame, id_col: str, text_col: str, score: Callable, threshold: float, whole: bool) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row; with ``whole``, all
    columns of the row as the struct ``row`` in place of id_col, so that what
    is decided of a row acts on that row, whatever its id.  ``score``: texts
    -> array of their scores."""
    bounded_batches(docs.sparkSession)
    rows, put = pick(docs, {"doc_id": id_col, "text": text_col}), ["doc_id"]
    if whole:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
        rows, put = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), rest.alias("rest")), ["doc_id", "text", "rest"]

    def run(batches):
        forget("_textflow_encoders")
        for batch in batches:
            scores = [score(values) for _, values in chunks(batch["text"])]
            if scores:
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in put], pa.array(np.concatenate(scores), pa.float64())], [*put, "score"])
        give_back()

    found = rows.mapInArrow(run, StructType([*[rows.schema[c] for c in put], StructField("score", DoubleType())]))
    first = F.struct(*[(F.col("text") if c == text_col else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]).alias("row") if whole else F.col("doc_id").alias(id_col)
    return found.select(first, F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
