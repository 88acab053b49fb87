"""Sources and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.session import checkpoint_dir

SEPARATORS = {"csv": ",", "tsv": "\t"}


def read_delimited(spark: SparkSession, path: str, fmt: str = "csv", schema=None,
                   header: bool = True) -> DataFrame:
    """Delimited text with a header; types inferred unless a schema is given
    (give one at scale: inference reads the data twice)."""
    reader = spark.read.option("header", header).option("sep", SEPARATORS[fmt])
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def write_delimited(df: DataFrame, path: str, fmt: str = "csv") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", SEPARATORS[fmt]).csv(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def with_row_id(df: DataFrame, name: str = "_id", order_by: str | None = None) -> DataFrame:
    """Add a row id unless present.  Without ``order_by``: unique but
    partition-dependent (monotonically_increasing_id).  With an integer
    ``order_by`` unique key: dense 0..n-1 by that key, computed without a
    one-partition window."""
    if name in df.columns:
        return df
    if order_by is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    from textflow.operators.partitioned import position_index
    return position_index(df, order_by, name=name)


def sql_source(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """S3: a frame from SQL text; keyword frames are referenced as {name}."""
    return spark.sql(text, **tables)


def table_source(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view."""
    return spark.table(name)


def jdbc_source(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
                driver: str | None = None, partition: dict | None = None, **props) -> DataFrame:
    """An external database through JDBC.  With ``partition`` =
    {column, lowerBound, upperBound, numPartitions} the read is split into
    parallel range queries (needs ``table``, not ``query``)."""
    r = spark.read.format("jdbc").option("url", url)
    if driver:
        r = r.option("driver", driver)
    if partition:
        if table is None:
            raise ValueError("a partitioned read needs table=")
        r = r.option("dbtable", table)
        for k in ("column", "lowerBound", "upperBound", "numPartitions"):
            r = r.option("partitionColumn" if k == "column" else k, str(partition[k]))
    elif query is not None:
        r = r.option("query", query)
    else:
        r = r.option("dbtable", table)
    for k, v in props.items():
        r = r.option(k, v)
    return r.load()


def cached(df: DataFrame, level=None) -> DataFrame:
    """S6."""
    from pyspark import StorageLevel
    return df.persist(level or StorageLevel.MEMORY_AND_DISK)


def arff_lines(df: DataFrame, vector: str = "feature_vec", weight: str = "weight",
               label: str = "class") -> DataFrame:
    """S7 data lines: vector values, weight, class joined by ','."""
    from pyspark.ml.functions import vector_to_array
    vals = F.transform(vector_to_array(F.col(vector)), lambda x: x.cast("string"))
    return df.select(F.concat_ws(",", F.concat(vals, F.array(F.col(weight).cast("string"),
                                                               F.col(label).cast("string"))))
                     .alias("value"))


def arff_header(attributes, relation: str = "reports", label: str = "class") -> str:
    lines = [f"@RELATION {relation}", ""]
    for a in attributes:
        lines.append("@ATTRIBUTE class {0,1}" if a == label else f"@ATTRIBUTE {a}  NUMERIC")
    lines += ["", "@DATA"]
    return "\n".join(lines) + "\n"


def write_arff(df: DataFrame, path: str, attributes, vector: str = "feature_vec") -> str:
    """ARFF export as a folder: 'header' (one small file) and 'data'
    (part files written in parallel by the executors; no collect)."""
    spark = df.sparkSession
    spark.createDataFrame([(arff_header(attributes),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(os.path.join(path, "header"))
    arff_lines(df, vector).write.mode("overwrite").text(os.path.join(path, "data"))
    return path


def save_model(model, path: str) -> str:
    """S11."""
    model.write().overwrite().save(path)
    return path


def load_model(cls, path: str):
    """``cls`` is the model class, e.g. PipelineModel."""
    return cls.load(path)
