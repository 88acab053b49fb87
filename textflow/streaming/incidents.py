"""Streaming: the stateless row operators on a file stream.

Incident extractors (X1-X10, T12, T11) and the normalizing tokenizer are
per-row expressions, so the same code runs on ``readStream`` input.  The
sink writes each micro-batch to a table folder; the checkpoint lives in the
shared folder named by ``spark.checkpoint.dir``, so a restarted query resumes
where it stopped (exactly-once file sink).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from textflow.operators.text import normalized_tokens
from textflow.plans.incidents import incident_features
from textflow.session import checkpoint_dir


def stream_reports(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """Report files (parquet) arriving in ``path`` as a streaming frame."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def stream_incident_features(reports: DataFrame) -> DataFrame:
    """X11 (+ method-of-entry tokens) on a streaming frame."""
    f = incident_features(reports)
    return f.withColumn("moe_tokens", normalized_tokens("method_of_entry"))


def write_stream(df: DataFrame, out_path: str, name: str, available_now: bool = True):
    """Start the query into a parquet folder; returns the StreamingQuery."""
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), f"stream-{name}")
    w = df.writeStream.format("parquet").option("checkpointLocation", ckpt) \
        .option("path", out_path).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
