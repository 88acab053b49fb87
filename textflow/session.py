"""Session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the bench and local runs.  On a cluster the caller passes its
own ``SparkSession``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE re-plans joins at run
# time; lookups of per-key values salt hot keys themselves (partitioned.lookup).
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Spark's setting: shuffle files go when the query that made them ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "textflow",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return a session for local work (tests, bench)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.driver.memory"] = os.environ.get("TEXTFLOW_DRIVER_MEMORY", "16g")
    conf["spark.ui.enabled"] = "false"
    conf["spark.sql.shuffle.partitions"] = "8"  # for local cores; a cluster job sets its own
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be given (a folder every executor can
    reach).  Only a local-mode session without the setting gets a private
    folder, as in tests.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^,\]]*(,\d+)?\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        path = tempfile.mkdtemp(prefix="textflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """``df`` written once into the shared checkpoint folder (never a local
    one) and read back, so that what reads it does not compute it again.

    Parquet, not an RDD checkpoint: columns are compressed and later readers
    take only those that they use, and no cached copy lies beside the files.
    What was shuffled for it is removed as soon as it is written."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df) -> None:
    """Removes the files of a frame that ``cut_lineage`` wrote and nothing reads any more."""
    spark = df.sparkSession
    top = checkpoint_dir(spark).rstrip("/")
    files = df.inputFiles()
    if not files:
        return
    cut = re.search(r"/(cut-[0-9a-f]{32})/", files[0])
    if cut:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{cut[1]}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
