"""Report linkage (K1-K5, D6-D13): label report pairs and turn them into
distance features, all as distributed joins.

The reference gathered every report on the driver and paired them in Python
loops.  Here: per-key counts are partial aggregations, primary offenders are a
``min_by`` aggregation, positive pairs a blocked self-join, negative pairs an
integer draw plus two equi-joins, distances native expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from textflow.functions import distance as D
from textflow.operators.dots import dot
from textflow.operators.pair_cells import drawn_pairs
from textflow.operators.partitioned import blocked_pairs, checked_broadcast, lookup, position_index
from textflow.session import cut_lineage

# Report-side tables up to this many rows are broadcast to the pair joins
# (each row: a few ints and two short term maps); larger ones are shuffled.
SIDE_BROADCAST_ROWS = 500_000
SIDE_BROADCAST_ENTRIES = 8_000_000  # term-map entries (about 24 bytes each)


def attach_count(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows per key looked up back onto every row (partial aggregation +
    equi-join, the rows of hot keys salted)."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return lookup(df, counts, key, size=name)


def count_by(df: DataFrame, key: str, name: str = "count") -> DataFrame:
    """A1: rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def primary_by(df: DataFrame, group: str, value: str, measure: str, rows: str | None = None) -> DataFrame:
    """A3: per group, the value whose measure is largest (ties: smallest value);
    with ``rows`` also the sum of that column."""
    return df.groupBy(group).agg(
        F.min_by(F.col(value), F.struct(-F.col(measure), F.col(value))).alias(value),
        *([F.sum(rows).alias(rows)] if rows else []))


def primary_offender(df: DataFrame, fingerprint: str = "narrative_hash",
                     offender: str = "offender", narrative: str = "narrative",
                     blank: str = "keep") -> DataFrame:
    """K1: reports sharing a narrative fingerprint all get the offender with
    the most reports (ties: smallest offender id).

    ``blank='keep'`` leaves reports with an empty narrative with their own
    offender; ``'merge'`` treats the empty narrative as one fingerprint, as
    the reference did.
    """
    if blank not in ("keep", "merge"):
        raise ValueError("blank must be 'keep' or 'merge'")
    counts = count_by(df, offender, "_cnt")
    named = F.col(offender)
    if blank == "keep":
        named = F.when(F.coalesce(F.col(narrative), F.lit("")) != "", named)
    seen = df.select(fingerprint, named.alias(offender)).groupBy(fingerprint, offender).agg(F.count(F.lit(1)).alias("_rows"))
    cand = lookup(seen.where(F.col(offender).isNotNull()), counts, offender, size="_cnt")
    # rows that name nobody only count: their fingerprint, too, may be that of many
    cand = cand.unionByName(seen.where(F.col(offender).isNull()).withColumn("_cnt", F.lit(-1).cast("long")))
    best = primary_by(cand, fingerprint, offender, "_cnt", rows="_rows").withColumnRenamed(offender, "_primary")
    out = lookup(df, best, fingerprint, "left", size="_rows").drop("_rows")
    return out.withColumn(offender, F.coalesce(F.col("_primary"), F.col(offender))).drop("_primary")


def link_stats(df: DataFrame, group: str, ratio: int = 1, id_col: str | None = None) -> DataFrame:
    """A5: one row: groups, linked (sum of n choose 2), reports, to_select
    (ceil(linked / groups) * ratio) and the class balance ratio.  With
    ``id_col`` also the id range (min_id, max_id) from the same pass."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    if id_col:
        aggs += [F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi")]
    sizes = df.groupBy(group).agg(*aggs)
    out = [F.count(F.lit(1)).alias("groups"),
           F.sum(F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("linked"),
           F.sum("_n").cast("long").alias("reports")]
    if id_col:
        out += [F.min("_lo").alias("min_id"), F.max("_hi").alias("max_id")]
    s = sizes.agg(*out)
    s = s.withColumn("to_select", (F.ceil(F.col("linked") / F.col("groups")) * F.lit(ratio)).cast("long"))
    return s.withColumn(
        "balance", F.try_divide(F.col("to_select") * F.col("reports"),
                                F.col("linked") + F.col("to_select") * F.col("reports")))


def positive_pairs(df: DataFrame, group: str = "offender", id_col: str = "incident_id",
                   block: int = 256, left=(), right=()) -> DataFrame:
    """K2: every unordered pair inside a group; weight 1/n, class 1.

    The output itself has sum(n choose 2) rows; the blocked self-join spreads
    the pairs of one large group over many tasks.  ``left`` and ``right``:
    columns of ``df`` that a pair carries as l_<c> and r_<c>.
    """
    p = blocked_pairs(df, group, id_col, block=block, cols=dict.fromkeys([*left, *right]))
    return p.select("l", "r", (F.lit(1.0) / F.col("n")).alias("weight"),
                    F.lit(1).alias("class"), *[f"l_{c}" for c in left], *[f"r_{c}" for c in right])


def negative_pairs(df: DataFrame, group: str = "offender", id_col: str = "incident_id",
                   ratio: int = 1, seed: int = 0, stats: dict | None = None, left=(), right=()) -> DataFrame:
    """K3: each report draws K = ceil(linked / groups) * ratio distinct other
    groups and one report of each; weight 1.0, class 0.

    The draw is integer arithmetic on (report id, j), so it is replayable and
    the same in SQL.  Groups are numbered 0..G-1 by their smallest report id
    and reports 0..n-1 inside their group by id.  A report's number
      h = (x mod M + (x div M mod M) * 40503) mod M,  x = id + seed, M = 2^31 - 1
    keys a permutation p of 0..G-2 (``draws``), so its K targets
      tg = (gid + 1 + p(j)) mod G,  j = 0..K-1
    are distinct, never its own group, and independent of those of other
    reports; the report of a target group is chosen by a hash of keys and j.
    Raises ValueError when K > G - 1 (not enough other groups).  ``left`` and
    ``right``: columns of ``df`` that a pair carries as l_<c> and r_<c>.  No
    draw is written or shuffled as a row (``pair_cells``).
    """
    # ids may come as int (inferred from a file); the draw needs 64 bits
    df = df.withColumn(id_col, F.col(id_col).cast("long"))
    if stats is None:
        stats = link_stats(df, group, ratio, id_col=id_col).first().asDict()
    g, k = int(stats["groups"]), int(stats["to_select"] or 0)
    schema = StructType([StructField("l", LongType()), StructField("r", LongType()),
                         StructField("weight", DoubleType(), False),
                         StructField("class", IntegerType(), False)])
    if k == 0:
        return df.sparkSession.createDataFrame([], StructType([*schema, *(StructField(f"{m}_{c}", df.schema[c].dataType) for m, cs in (("l", left), ("r", right)) for c in cs)]))
    if k > g - 1:
        raise ValueError(f"need {k} other groups per report but only {g - 1} exist")
    cols = list(dict.fromkeys([*left, *right]))
    groups = df.groupBy(group).agg(F.min(id_col).alias("_gkey"), F.count(F.lit(1)).alias("_n"))
    groups = cut_lineage(position_index(groups, "_gkey", name="_gid"))
    reports = lookup(df.select(id_col, group, *cols), groups.select(group, "_gid", "_n"), group, size="_n").drop(group)
    drawn = drawn_pairs(reports, groups, id_col, g, k, seed, left, right)
    carried = [c for c in drawn.columns if c not in ("l", "r")]
    return drawn.select("l", "r", F.lit(1.0).alias("weight"), F.lit(0).alias("class"), *carried)


class LabelledPairs:
    """Positive and negative pairs of reports that are not made yet.  Operators
    that want columns of both reports name them before (``with_sides``), so the
    steps that make the pairs carry them along, and no pair is shuffled, nor
    written, to meet its reports."""

    columns = ["l", "r", "weight", "class"]

    def __init__(self, reports: DataFrame, group: str = "offender", id_col: str = "incident_id", ratio: int = 1, seed: int = 0,
                 stats: dict | None = None):
        self.reports, self.group, self.id_col = reports.withColumn(id_col, F.col(id_col).cast("long")), group, id_col
        self.ratio, self.seed = ratio, seed
        self.stats = stats or link_stats(reports, group, ratio, id_col=id_col).first().asDict()

    def _made(self, reports: DataFrame, left=(), right=()) -> DataFrame:
        return positive_pairs(reports, self.group, self.id_col, left=left, right=right).unionByName(
            negative_pairs(reports, self.group, self.id_col, self.ratio, self.seed, self.stats, left=left, right=right), allowMissingColumns=True)

    def frame(self) -> DataFrame:
        return self._made(self.reports.select(self.id_col, self.group))

    def with_sides(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """The pairs with the columns of both reports as l_<c> and r_<c>; a
        report has one row in ``left`` and ``right``, or none and nulls."""
        reports, names = self.reports.select(self.id_col, self.group), []
        sides = [left] if left is right else [left, right]
        for i, side in enumerate(sides):
            cols = {c: f"_{i}{c}" for c in side.columns if c != self.id_col}
            names.append(cols)
            reports = reports.join(side.select(self.id_col, *[F.col(c).alias(x) for c, x in cols.items()]), self.id_col, "left")
        made = self._made(cut_lineage(reports), names[0].values(), names[-1].values())
        renamed = {f"{mark}_{x}": f"{mark}_{c}" for mark, cols in zip("lr", (names[0], names[-1])) for c, x in cols.items()}
        return made.withColumnsRenamed(renamed)


# --- distances -------------------------------------------------------------------

# feature -> (distance kind, report column(s)) in the reference's order
DISTANCES = [
    ("location_code", "nominal", ["location_code"]),
    ("ordinal_date", "abs", ["ordinal_date"]),
    ("hour", "hour", ["hour"]),
    ("entry_location", "nominal", ["entry_location"]),
    ("entry_point", "nominal", ["entry_point"]),
    ("day_of_week", "weekday", ["day_of_week"]),
    ("grid_distance", "grid", ["northing", "easting"]),
    ("messy", "nominal", ["messy"]),
    ("property_secure", "nominal", ["property_secure"]),
]


def _distance(kind, lcols, rcols):
    if kind == "nominal":
        return D.nominal_match(lcols[0], rcols[0])
    if kind == "abs":
        return D.abs_gap(lcols[0], rcols[0])
    if kind == "hour":
        return D.hour_gap(lcols[0], rcols[0])
    if kind == "weekday":
        return D.weekday_gap(lcols[0], rcols[0])
    if kind == "grid":
        return D.grid_distance(lcols[0], lcols[1], rcols[0], rcols[1])
    raise ValueError(kind)


def pair_features(pairs: DataFrame, reports: DataFrame, id_col: str = "incident_id",
                  specs=DISTANCES, vectors: dict | None = None,
                  checkpoint_side: bool = True) -> DataFrame:
    """K4: join both reports of each pair once and compute every distance.

    ``vectors``: optional {name: (id, terms, norm) frame}; each adds a cosine
    column ``name`` (see ``pair_cosines``).  The scalar report columns form a
    small side table joined to each pair side once.
    """
    need = sorted({c for _, _, cs in specs for c in cs})
    side = reports.select(id_col, *need)
    side = checked_broadcast(side, SIDE_BROADCAST_ROWS)
    left = side.select(F.col(id_col).alias("l"), *[F.col(c).alias(f"l_{c}") for c in need])
    right = side.select(F.col(id_col).alias("r"), *[F.col(c).alias(f"r_{c}") for c in need])
    x = pairs.join(left, "l").join(right, "r")
    feats = [_distance(kind, [f"l_{c}" for c in cs], [f"r_{c}" for c in cs]).alias(name)
             for name, kind, cs in specs]
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    out = x.select("l", "r", *feats, *rest)
    if vectors:
        names, terms = _vector_side(vectors, id_col, checkpoint_side)
        out = _with_cosines(out, terms, names, id_col)
    return out


def pair_table(pairs: DataFrame, reports: DataFrame, vectors: DataFrame, names, id_col: str = "incident_id",
               specs=DISTANCES, property_senses: tuple | None = None) -> DataFrame:
    """K4 in one pass: every feature of every pair from one side table.

    The side holds each report's scalars, term maps (``vectors``: id, _f0, _t0,
    _n0, _f1, ..., see ``method_vectors``; one cosine for each of ``names``) and, with ``property_senses``
    (sense lists, ancestors by number, distances, depth; see ``senses``), its
    senses.  ``LabelledPairs`` carry it from where they are made; a table of
    pairs is joined to the left and to the right reports once (broadcast when
    the checked size allows).  Distances, cosines and the sense assignment are
    expressions of the row, so no pair is shuffled again; each map is read from
    one side only."""
    need = sorted({c for _, _, cs in specs for c in cs})
    side = reports.select(id_col, *need).join(vectors, id_col, "left")
    if property_senses:
        side = side.join(property_senses[0], id_col, "left")
    side = cut_lineage(side)
    short = {f"_f{i}" for i in range(len(names))}
    cols = [c for c in side.columns if c != id_col]
    left, right = side.select(id_col, *[c for c in cols if not c.startswith("_t")]), side.select(id_col, *[c for c in cols if c not in short])
    if isinstance(pairs, LabelledPairs):
        x = _with_rows(pairs, left, right, id_col)
    else:
        held = [c for c in cols if c.startswith("_t") or c == "senses"]
        weight = sum((F.coalesce(F.size(c), F.lit(0)) for c in held), F.lit(0))
        few = checked_broadcast(side, SIDE_BROADCAST_ROWS, weight=weight, max_weight=SIDE_BROADCAST_ENTRIES) is not side
        x = pairs
        for mark, one in (("l", left), ("r", right)):
            one = one.select(F.col(id_col).alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in one.columns if c != id_col])
            x = x.join(F.broadcast(one) if few else one, mark)
    feats = [_distance(kind, [f"l_{c}" for c in cs], [f"r_{c}" for c in cs]).alias(name) for name, kind, cs in specs]
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    if property_senses:
        from textflow.operators.senses import assigned_similarity
        rest.append(assigned_similarity(F.col("l_senses"), F.col("r_senses"), *property_senses[1:]).alias("property_senses"))
    for i, name in enumerate(names):
        total = dot(F.col(f"l__f{i}"), F.col(f"r__t{i}"))
        rest.append(F.try_divide(total, F.col(f"l__n{i}") * F.col(f"r__n{i}")).alias(name))
    return x.select("l", "r", *feats, *rest)


def _with_rows(pairs: LabelledPairs, left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """``with_sides`` for frames that may have several rows for a report (its id
    is given twice): a pair meets each of them."""
    if left.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 and `{id_col}` is not null").limit(1).count() == 0:
        return pairs.with_sides(left, right)
    every = [side.groupBy(id_col).agg(F.collect_list(F.struct(*[c for c in side.columns if c != id_col])).alias("rows")) for side in (left, right)]
    x = pairs.with_sides(*every)
    for mark in ("l", "r"):
        x = x.withColumn(f"{mark}_row", F.explode(f"{mark}_rows")).drop(f"{mark}_rows")
    rest = [c for c in x.columns if c not in ("l_row", "r_row")]
    return x.select(*rest, *[F.col(f"{mark}_row.{c}").alias(f"{mark}_{c}") for mark, side in (("l", left), ("r", right)) for c in side.columns if c != id_col])


def _vector_side(vectors: dict, id_col: str, write: bool = True) -> tuple[list, DataFrame]:
    """The names and one table (id, _t0, _n0, _t1, ...) of several vector sets."""
    names, side = list(vectors), None
    for i, name in enumerate(names):
        v = vectors[name].select(id_col, F.col("terms").alias(f"_t{i}"), F.col("norm").alias(f"_n{i}"))
        side = v if side is None else side.join(v, id_col, "full")
    return names, cut_lineage(side) if write else side


def _with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, held, id_col: str) -> DataFrame:
    """``pairs`` with the columns of both reports as l_<c> and r_<c>, null for a
    report without a row; a pair stays one row, whatever its reports hold.
    ``held``: the columns whose sizes decide on a broadcast."""
    if isinstance(pairs, LabelledPairs):
        return pairs.with_sides(left, right)
    weight = sum((F.coalesce(F.size(c), F.lit(0)) for c in held), F.lit(0))
    for mark, side in (("l", left), ("r", right)):
        cols = [c for c in side.columns if c != id_col]
        side = checked_broadcast(side, SIDE_BROADCAST_ROWS, weight=weight, max_weight=SIDE_BROADCAST_ENTRIES)
        pairs = pairs.join(side.select(F.col(id_col).alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in cols]), mark, "left")
    return pairs


def _with_cosines(pairs: DataFrame, side: DataFrame, names, id_col: str) -> DataFrame:
    """``pairs`` and the cosine of each of ``names`` as a column."""
    x = _with_sides(pairs, side, side, [f"_t{i}" for i in range(len(names))], id_col)
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    return x.select("l", "r", *rest, *[F.try_divide(dot(F.col(f"l__t{i}"), F.col(f"r__t{i}")), F.col(f"l__n{i}") * F.col(f"r__n{i}")).alias(name)
                                       for i, name in enumerate(names)])


def add_cosines(features: DataFrame, pairs: DataFrame, side: DataFrame, names,
                id_col: str) -> DataFrame:
    """Attach the cosines computed from a prepared vector side table."""
    cos = pair_cosines(pairs, None, id_col, side=side, names=names)
    return features.join(cos, ["l", "r"], "left")


def pair_cosines(pairs: DataFrame, vectors: dict | None, id_col: str,
                 checkpoint_side: bool = True, side: DataFrame | None = None,
                 names=None) -> DataFrame:
    """D6/D7/D8 for several vector sets at once -> (l, r, <name>...), one row
    per distinct pair.

    The term maps of both sides are joined on (broadcast when the checked size
    allows) and the products of the shared keys are summed inside the row.
    Keys of the different vector sets are hashes of different term kinds.
    """
    if side is None:
        names, side = _vector_side(vectors, id_col, checkpoint_side)
    elif checkpoint_side:
        side = cut_lineage(side)
    return _with_cosines(pairs.select("l", "r").distinct(), side, list(names), id_col)


def pair_cosine(pairs: DataFrame, vectors: DataFrame, id_col: str, name: str) -> DataFrame:
    """Cosine of the two term-weight vectors of each pair.

    ``vectors``: (id, terms map<key,double>, norm) from term_vectors.  A
    report without terms, or with a zero vector, gives null (imputed later).
    """
    names, side = _vector_side({name: vectors}, id_col)
    return _with_cosines(pairs, side, names, id_col)


def pair_overlap(pairs: DataFrame, terms: DataFrame, id_col: str, term: str = "term",
                 idf: DataFrame | None = None, name: str = "overlap") -> DataFrame:
    """Matching (i, j) term pairs / ((nx + 1)(ny + 1)); an empty side -> null.

    ``terms`` is long (id, term) with repeats; matches are sum over shared terms
    of cx * cy (optionally times idf(term)).  Terms are numbered and a report's
    counts are one short map, so a pair stays one row and its matches are summed
    inside it; the idf is a factor of the left map.
    """
    cnt = terms.groupBy(id_col, F.col(term).alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    cnt = cut_lineage(cnt)  # read twice
    known = cnt.where("_t is not null").groupBy("_t").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_h", F.xxhash64("_t"))
    known = position_index(known, "_h", name="_k").select("_t", "_rows", F.col("_k").cast("int").alias("_k"))
    if idf is not None:
        weights = idf.groupBy(F.col(term).alias("_t")).agg(F.sum("idf").alias("_w"))
        known = known.join(weights, "_t", "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    cnt = lookup(cnt, known, "_t", "left", size="_rows")
    factor = F.col("_c") * F.col("_w") if idf is not None else F.col("_c")

    def by_number(value):
        entry = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("k"), value.cast("double").alias("v")))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    side = cut_lineage(cnt.groupBy(id_col).agg(F.sum("_c").alias("_s"), by_number(F.col("_c")).alias("_t"), *([by_number(factor).alias("_f")] if idf is not None else [])))
    right = side.drop("_f")
    left = side.select(id_col, "_s", F.col("_f").alias("_t")) if idf is not None else right
    x = _with_sides(pairs, left, right, ["_t"], id_col)
    val = dot(F.col("l__t"), F.col("r__t")) / ((F.col("l__s") + 1) * (F.col("r__s") + 1))
    return x.select("l", "r", *[c for c in pairs.columns if c not in ("l", "r")], val.alias(name))


# --- missing values, assembly, scaling (K5) -------------------------------------

def finish_features(df: DataFrame, keep=("weight", "class"), ids=("l", "r")):
    """K5: fill int features with their mean rounded half-to-even, impute
    double features with their mean (null and NaN are missing), assemble
    'raw_feature_vec' and min-max scale it to [0, 1] as 'feature_vec'
    (a constant slot gives 0.5).

    Same results as na.fill + Imputer + VectorAssembler + MinMaxScaler, but
    one aggregation pass gives every statistic: filling with a mean never
    moves a column's min or max, so min/max of the filled column are those of
    its present values.  Returns (scaled, raw, feature_names); ``raw`` has
    the filled columns (doubles renamed <c>_imputed, as Imputer names them).
    """
    from pyspark.ml.functions import array_to_vector
    dtypes = dict(df.dtypes)
    feats = [c for c in df.columns if c not in keep and c not in ids]
    ints = [c for c in feats if dtypes[c] not in ("float", "double")]
    dbls = [c for c in feats if dtypes[c] in ("float", "double")]

    def present(c):
        return F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)) if c in dbls else F.col(c)

    aggs = []
    for c in feats:
        aggs += [F.avg(present(c)).alias(f"a_{c}"), F.min(present(c)).alias(f"lo_{c}"),
                 F.max(present(c)).alias(f"hi_{c}")]
    st = df.agg(*aggs).first().asDict()
    empty = [c for c in feats if st[f"a_{c}"] is None]
    if empty and any(True for _ in df.take(1)):
        raise ValueError(f"no value to fill or scale: every row is null in {empty}")
    filled = []
    for c in ints:
        mean = st[f"a_{c}"]
        fill = F.lit(None) if mean is None else F.bround(F.lit(mean), 0).cast(dtypes[c])
        filled.append(F.coalesce(F.col(c), fill).alias(c))
    for c in dbls:
        mean = st[f"a_{c}"]
        fill = F.lit(None).cast("double") if mean is None else F.lit(float(mean))
        filled.append(F.coalesce(present(c), fill).alias(c + "_imputed"))
    raw = df.select(*ids, *filled, *keep)
    names = ints + [c + "_imputed" for c in dbls]
    scaled_cols = []
    for c, n in zip(ints + dbls, names):
        lo, hi = st[f"lo_{c}"], st[f"hi_{c}"]
        x = F.col(n).cast("double")
        if lo is None or hi == lo:
            scaled_cols.append(F.when(x.isNull(), F.lit(None)).otherwise(F.lit(0.5)))
        else:
            scaled_cols.append((x - F.lit(float(lo))) / F.lit(float(hi - lo)))
    out = raw.select(*ids, array_to_vector(F.array(*[F.col(n).cast("double") for n in names]))
                     .alias("raw_feature_vec"), *keep,
                     array_to_vector(F.array(*scaled_cols)).alias("feature_vec"))
    return out, raw, names
