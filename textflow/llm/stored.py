"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

A written table cuts lineage: a lost executor cannot make a later stage see
other rows, and both inputs of a later join are plain scans, so that Spark can
split a hot key of that join at run time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textflow.session import checkpoint_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that nothing reads any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch of texts, unless the session sets another bound.
BATCH_BYTES = 1 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let a task hand texts to Python about a megabyte at a time, so that its
    memory does not follow the mean length of texts.  A bound that the session
    has already set stays."""
    if spark.conf.get(_BATCHES, "64m") == "64m":
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def pick(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Only the columns that an operator reads, under the operator's own names,
    so that extra columns of the caller cannot clash.  ``wanted``: own name ->
    caller's name."""
    return df.select(*[df[f"`{c}`"].alias(own) for own, c in wanted.items()])
