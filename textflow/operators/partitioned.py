"""Skew-safe building blocks: positions without a one-partition window,
blocked self-pairing, capped-size broadcast.

Every helper keeps the work of one hot key spread over many tasks; what is
broadcast has a proven bound (a fixed cell count, or a size check).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textflow.session import cut_lineage

# Largest number of cells a single offset window may see (bounded work in one task).
MAX_CELLS = 1 << 11
# Copies of a per-key row among which the rows of one key are dealt out.
SALTS = 8
# A key is hot if it has at least one in so many of all rows, so fewer keys than this are.
HEAVY = 1 << 10
# Rows a broadcast side may hold when its size is only known at run time.
BROADCAST_ROWS = 2_000_000
# Keys of counted per-key rows (a key and some numbers) that are sent to the rows instead.
BROADCAST_KEYS = 1_000_000


def lookup(rows: DataFrame, per_key: DataFrame, key, how: str = "inner",
           size: str | None = None, salts: int | None = None, twice: bool = False) -> DataFrame:
    """Join ``rows`` to a table with few rows per key, without sending the rows
    of one hot key to one task.

    Rows are salted by a hash of their columns (so a recomputed task deals
    them out the same way) and meet a copy of the key's row for each salt.
    ``size``: the column of ``per_key`` that counts the rows of each key; then
    up to BROADCAST_KEYS keys are broadcast and the rows stay where they are,
    and of more only hot keys are salted and copied, of which there are fewer
    than HEAVY (a proven broadcast bound).  ``how``: inner or left.

    ``twice``: the rows are cheap enough to be read twice.  Then, of more keys,
    the up to BROADCAST_KEYS with the most rows are broadcast and only rows of
    the others are shuffled; none of these is hot.
    """
    keys = [key] if isinstance(key, str) else list(key)
    plain = [F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t]
    salts = salts or (SALTS if size is None else 8 * SALTS)
    salt = F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    last = F.lit(salts - 1)
    if size is not None:
        per_key = cut_lineage(per_key)
        known = per_key.agg(F.sum(size).alias("total"), F.count(F.lit(1)).alias("keys")).first()
        if known["keys"] <= BROADCAST_KEYS:
            return rows.join(F.broadcast(per_key), keys, how)
        if twice:
            return _lookup_frequent(rows, per_key, keys, how, size)
        total = known["total"] or 0
        hot = F.broadcast(per_key.where(F.col(size) * HEAVY > F.lit(total)).select(*keys, F.lit(True).alias("_hot")))
        rows, per_key = rows.join(hot, keys, "left"), per_key.join(hot, keys, "left")
        salt = F.when(F.col("_hot"), salt).otherwise(F.lit(0))
        last = F.when(F.col("_hot"), last).otherwise(F.lit(0))
    rows = rows.withColumn("_salt", salt)
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
    if size is not None:
        rows, copies = rows.drop("_hot"), copies.drop("_hot")
    return rows.join(copies, [*keys, "_salt"], how).drop("_salt")


def _lookup_frequent(rows: DataFrame, per_key: DataFrame, keys: list, how: str, size: str) -> DataFrame:
    """``lookup`` of more keys than are broadcast: those with the most rows are,
    by powers of two of ``size`` (a row each reaches the driver)."""
    band = F.floor(F.log2(F.greatest(F.col(size), F.lit(1))))
    bands = per_key.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("band")).collect()
    sent, least = 0, None
    for b in bands:
        if sent + b["keys"] > BROADCAST_KEYS:
            break
        sent, least = sent + b["keys"], b["band"]
    if least is None:
        return rows.join(per_key, keys, how)
    many, few = F.broadcast(per_key.where(band >= least)), per_key.where(band < least)
    return rows.join(many, keys).unionByName(rows.join(many.select(*keys), keys, "left_anti").join(few, keys, how))


def cells(df: DataFrame, order_col: str, max_cells: int = MAX_CELLS, name: str = "_cell") -> DataFrame:
    """``df`` with the number of the cell of its ``order_col``: cells follow one
    another in its order and hold about equally many rows, however the values
    are spread (approximate quantiles)."""
    value = F.col(order_col).cast("double")
    cuts = df.select(value.alias("_x")).approxQuantile("_x", [i / max_cells for i in range(1, max_cells)], 0.25 / max_cells)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    out = Bucketizer(splits=splits, inputCol="_x", outputCol=name, handleInvalid="keep").transform(df.withColumn("_x", value))
    return out.withColumn(name, F.col(name).cast("int")).drop("_x")


def position_index(df: DataFrame, order_col: str, by=(), name: str = "_pos",
                   max_cells: int = MAX_CELLS) -> DataFrame:
    """0-based position of each row by ``order_col`` within ``by`` (or overall).

    ``order_col`` is an integer unique within ``by``.  Rows are cut into cells
    of consecutive ``order_col`` values (about equally many rows each), ranked
    inside their cell, and offset by the sizes of the earlier cells of the same
    group.  No task ever holds a whole group; the only unpartitioned window
    runs over at most ``max_cells`` cell sizes.  The result depends on the data
    only (not on partitioning or the cuts), so recomputation after a lost
    executor gives the same numbers.
    """
    by = list(by)
    x = cells(df, order_col, max_cells)
    ranked = x.withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order_col)) - 1)
    sizes = x.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    if not by:
        # at most max_cells rows: a proven bound
        offsets = F.broadcast(offsets)
    return (ranked.join(offsets, [*by, "_cell"])
            .withColumn(name, (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_cell", "_r", "_off"))


def blocked_pairs(df: DataFrame, group: str, id_col: str, block: int = 256,
                  cols=()) -> DataFrame:
    """All unordered pairs (a.id < b.id) of rows sharing ``group``.

    A group of n rows is cut into ceil(n / block) hash blocks and each block
    pair (b <= c) is one join key, so one hot group's n^2/2 pairs are spread
    over many tasks instead of one.  Groups of at most ``block`` rows are a
    plain self-join.  Output: group, l, r, n (group size), plus ``cols`` of
    both sides as l_<c> / r_<c>.
    """
    cols = list(cols)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    x = (lookup(df.select(group, id_col, *cols), sizes, group, size="_n")
         .withColumn("_nb", F.expr(f"CAST(ceil(_n / {block}) AS INT)"))
         .withColumn("_b", F.expr("CAST(pmod(xxhash64({}), _nb) AS INT)".format(id_col))))
    left = x.select(group, "_n", F.col("_b").alias("_lb"),
                    F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)).alias("_rb"),
                    F.col(id_col).alias("l"), *[F.col(c).alias(f"l_{c}") for c in cols])
    right = x.select(group, F.col("_b").alias("_rb"),
                     F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_lb"),
                     F.col(id_col).alias("r"), *[F.col(c).alias(f"r_{c}") for c in cols])
    pairs = left.join(right, [group, "_lb", "_rb"])
    pairs = pairs.where((F.col("_lb") < F.col("_rb")) | (F.col("l") < F.col("r")))
    lo = F.least("l", "r")
    hi = F.greatest("l", "r")
    swap = F.col("l") > F.col("r")
    out = [group, lo.alias("l"), hi.alias("r"), F.col("_n").alias("n")]
    for c in cols:  # with the ids that least and greatest take, which pass over nulls
        out.append(F.when(F.col("l").isNull() | swap, F.col(f"r_{c}")).otherwise(F.col(f"l_{c}")).alias(f"l_{c}"))
        out.append(F.when(F.col("r").isNull() | swap, F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(f"r_{c}"))
    return pairs.select(*out)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                      weight=None, max_weight: int | None = None) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (and, with
    ``weight`` -- a per-row size column such as a map's entry count -- at most
    ``max_weight`` in total); else leave it to the planner (sort-merge join;
    AQE may still broadcast at run time).  One bounded pass decides."""
    if weight is None:
        n = df.limit(max_rows + 1).count()
        ok = n <= max_rows
    else:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w")).first()
        ok = row["n"] <= max_rows and (row["w"] or 0) <= max_weight
    return F.broadcast(df) if ok else df
