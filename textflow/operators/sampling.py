"""Samples that do not depend on partitioning.

Every row has a number u in (0, 1) by a hash of its key and the seed, so a
recomputed task, another cluster or a SQL engine draws the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashes are 32-bit; an exact sample finds its bound among so many ranges of them.
RANGES = 1 << 16


def key_hash(key: str, seed: int = 1) -> Column:
    """0 to 2^32 - 1: the first eight hexadecimal digits of the md5 of 'key:seed'; a null key counts as ''."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def sample_by_key(df: DataFrame, key: str, fraction: float, seed: int = 1) -> DataFrame:
    """Without replacement: each row with probability ``fraction``, by its
    key's hash; rows of one key stay or go together."""
    return df.where(key_hash(key, seed) < int(fraction * 2 ** 32))


def poisson_bounds(fraction: float) -> list[int]:
    """Hashes from which on a row is drawn once, twice, ...: the inverse of the Poisson distribution, to its last 2^-32."""
    bounds, total, term, n = [], 0.0, math.exp(-fraction), 0
    while True:
        total += term
        bound = int(total * 2 ** 32)
        if bound >= 2 ** 32 or term < 2.0 ** -60 and n > fraction:
            return bounds
        bounds.append(bound)
        n += 1
        term *= fraction / n


def sample_with_replacement(df: DataFrame, key: str, fraction: float, seed: int = 1, copy: str = "copy") -> DataFrame:
    """With replacement: each row as often as a Poisson draw of mean
    ``fraction`` says, its copies numbered from 1 in the column ``copy``."""
    h = key_hash(key, seed)
    times = sum(((h >= bound).cast("int") for bound in poisson_bounds(fraction)), F.lit(0))
    return df.withColumn("_times", times).where("_times > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), each as likely: those with
    the smallest hashes, equal ones by key.

    Counts of RANGES hash ranges give the range in which the last row lies;
    only that one is sorted, so no task orders the whole table.  Keys have to
    be distinct for the same rows on every run."""
    hashed = df.withColumn("_h", key_hash(key, seed))
    width = 2 ** 32 // RANGES
    counts = hashed.groupBy(F.expr(f"_h div {width}").alias("range")).count().collect()  # RANGES rows at most
    left = n
    for r in sorted(counts, key=lambda r: r.range):
        if left <= r["count"]:
            sure = hashed.where(F.col("_h") < r.range * width)
            rest = hashed.where((F.col("_h") >= r.range * width) & (F.col("_h") < (r.range + 1) * width))
            return sure.union(rest.orderBy("_h", key).limit(left)).drop("_h")
        left -= r["count"]
    return df
