"""Preview, profile and column roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, FloatType, DoubleType, DecimalType

CONTINUOUS_MIN_DISTINCT = 13


def preview(df: DataFrame, n: int = 100, vec: int = 10, order_by=None) -> DataFrame:
    """First n rows (by ``order_by``); arrays and vectors shown as their first
    ``vec`` elements ('%.4f') and '...', other columns as text."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.ml.functions import vector_to_array
    if order_by is not None:
        df = df.orderBy(order_by)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, VectorUDT):
            c = vector_to_array(c)
        if isinstance(f.dataType, VectorUDT) or f.dataType.typeName() == "array":
            head = F.transform(F.slice(c, 1, vec), lambda x: F.format_string("%.4f", x.cast("double")))
            more = F.when(F.size(c) > vec, F.lit(", ...")).otherwise(F.lit(""))
            out.append(F.concat(F.lit("["), F.array_join(head, ", "), more, F.lit("]")).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.limit(n).select(*out)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, position, n_rows, n_cols): one count plus the schema."""
    spark = df.sparkSession
    n = df.count()
    rows = [(name, t, i, n, len(df.columns)) for i, (name, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "column string, type string, position int, n_rows long, n_cols int")


def column_roles(df: DataFrame) -> DataFrame:
    """Numeric -> continuous if >= 13 distinct values, or floating, or
    max > distinct count; other numeric -> discrete (sorted value list);
    the rest -> meta.

    Pass 1: sketches of the distinct counts, and maxima, of all integer
    columns (no row is multiplied by the number of columns).  Pass 2: the
    value sets of the columns that the sketch gives at most twice the limit;
    near it a sketch is right to a few hundredths, so those sets are small and
    no column below the limit is missed.
    """
    spark = df.sparkSession
    floating = (FloatType, DoubleType, DecimalType)  # continuous anyway
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, floating)]
    stats, values = {}, {}
    if whole:
        stats = df.agg(*[x for c in whole for x in (F.approx_count_distinct(f"`{c}`", 0.02).alias(f"d_{c}"), F.max(f"`{c}`").alias(f"m_{c}"))]).first().asDict()
    few = [c for c in whole if stats[f"d_{c}"] <= 2 * CONTINUOUS_MIN_DISTINCT]
    if few:
        sets = df.agg(*[F.sort_array(F.collect_set(f"`{c}`")).alias(c) for c in few]).first().asDict()
        for c, found in sets.items():
            most = stats[f"m_{c}"]
            if len(found) < CONTINUOUS_MIN_DISTINCT and not (most is not None and most > len(found)):
                values[c] = ",".join(map(str, found))
    rows = []
    for f in df.schema.fields:
        if not isinstance(f.dataType, NumericType):
            rows.append((f.name, "meta", None))
        elif f.name in values:
            rows.append((f.name, "discrete", values[f.name]))
        else:
            rows.append((f.name, "continuous", None))
    return spark.createDataFrame(rows, "column string, role string, values string")
