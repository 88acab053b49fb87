"""Verbs with their objects and passive subjects, heads learned without labels.

Every noun has a few candidate heads, the verbs near it: those before it (it
may be their object) and those after it with a passive auxiliary in between
(it may be their passive subject).  Which head a noun takes is estimated by
expectation-maximisation from two kinds of grouped counts: how often a
candidate of a shape (side, distance, nouns and auxiliaries in between) is the
head, and how often a verb takes a noun.  All rounds are aggregations and
lookups; the shapes are few, the (verb, noun) table is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textflow.operators.partitioned import lookup
from textflow.session import cut_lineage

# The words that make the verb after them passive.
PASSIVE = ["am", "are", "be", "been", "being", "is", "was", "were"]
#: What every (verb, noun) counts beforehand, and the rounds of the estimate.
PRIOR, ROUNDS = 0.1, 2


def head_candidates(tagged: DataFrame, id_col: str = "doc_id", pos: str = "pos", token: str = "token", tag: str = "tag",
                    span: int = 4, passive=PASSIVE) -> DataFrame:
    """(id, pos, noun, vpos, verb, kind, shape): the verbs (VB*, auxiliaries
    aside) at most ``span`` tokens from each noun (NN*).  kind: dobj or
    nsubjpass.  ``span`` <= 9."""
    w = Window.partitionBy(id_col).orderBy(pos)
    # other words only count; what a neighbour needs is one value
    kind = F.when(F.col(tag).startswith("NN"), "NN").when(F.col(tag).startswith("VB"), "VB")
    word = F.when(kind.isNotNull() | F.col(token).isin(passive), F.col(token))
    tagged = tagged.select(id_col, pos, F.struct(F.col(pos).alias("p"), word.alias("t"), kind.alias("g")).alias("_own"))
    near = []
    for k in [*range(-span, 0), *range(1, span + 1)]:
        s = (F.lead if k > 0 else F.lag)("_own", abs(k)).over(w)
        near.append(F.struct(F.lit(k).alias("k"), s["p"].alias("p"), s["t"].alias("t"), s["g"].alias("g")))
    x = tagged.withColumn("_near", F.array(*near)).where("_own.g = 'NN'")
    heads = F.filter("_near", lambda s: F.coalesce(s["g"].startswith("VB"), F.lit(False)) & ~s["t"].isin(passive))
    x = x.select(id_col, F.col(pos).alias("pos"), F.col("_own.t").alias("noun"), "_near", F.explode(heads).alias("v"))
    between = F.expr("filter(_near, s -> s.k between least(v.k + 1, 1) and greatest(v.k - 1, -1))")
    x = x.withColumn("_between", between)
    listed = ", ".join(f"'{p}'" for p in passive)
    x = x.withColumn("_nouns", F.expr("size(filter(_between, s -> coalesce(s.g like 'NN%', false)))")) \
         .withColumn("_aux", F.expr(f"exists(_between, s -> coalesce(s.t in ({listed}), false))"))
    x = x.where((F.col("v.k") < 0) | F.col("_aux"))
    return x.select(id_col, "pos", "noun", F.col("v.p").alias("vpos"), F.col("v.t").alias("verb"),
                    F.when(F.col("v.k") < 0, "dobj").otherwise("nsubjpass").alias("kind"),
                    F.concat_ws(":", F.col("v.k").cast("string"), F.col("_nouns").cast("string"), F.col("_aux").cast("int").cast("string")).alias("shape"))


def _weighted(scored: DataFrame, id_col: str) -> DataFrame:
    """Scores to weights that sum to one over a noun's candidates."""
    return scored.withColumn("w", F.col("score") / F.sum("score").over(Window.partitionBy(id_col, "pos")))


def learned_scores(candidates: DataFrame, id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """``candidates`` with ``score``: (share of its shape's candidates that are
    heads) * (share of the verb's nouns that are this noun), after ``rounds``
    rounds from equal weights."""
    now = _weighted(candidates.withColumn("score", F.lit(1.0)), id_col)
    for _ in range(rounds):
        now = cut_lineage(now)
        shapes = now.groupBy("shape").agg((F.sum("w") / F.count(F.lit(1))).alias("_s"))  # at most 2 * span ** 2 * 2 rows
        pairs = now.groupBy("verb", "noun").agg(F.sum("w").alias("_w"), F.count(F.lit(1)).alias("_n"))
        verbs = pairs.groupBy("verb").agg(F.sum("_w").alias("_v"), F.count(F.lit(1)).alias("_kinds"), F.sum("_n").alias("_all"))
        rates = lookup(pairs, verbs.select("verb", "_v", "_kinds"), "verb").select(
            "verb", "noun", ((F.col("_w") + PRIOR) / (F.col("_v") + PRIOR * F.col("_kinds"))).alias("_p"), "_n")
        scored = lookup(now.drop("w", "score").join(F.broadcast(shapes), "shape"), rates, ["verb", "noun"], size="_n", twice=True)
        now = _weighted(scored.withColumn("score", F.col("_s") * F.col("_p")).drop("_s", "_p", "_n"), id_col)
    return now.drop("w")


def verb_relations(tagged: DataFrame, id_col: str = "doc_id", pos: str = "pos", token: str = "token", tag: str = "tag",
                   span: int = 4) -> DataFrame:
    """-> (id, pos, noun, vpos, verb, kind, relation): the best head of
    each noun that has a candidate (ties: the nearest, then the earlier verb).
    Null tokens and tags are no nouns and no verbs."""
    scored = learned_scores(head_candidates(tagged, id_col, pos, token, tag, span), id_col)
    order = F.struct((-F.round("score", 9)).alias("a"), F.abs(F.col("vpos") - F.col("pos")).alias("b"), F.col("vpos").alias("c"))
    best = scored.groupBy(id_col, "pos").agg(F.min_by(F.struct("noun", "vpos", "verb", "kind"), order).alias("x"))
    return best.select(id_col, "pos", "x.noun", "x.vpos", "x.verb", "x.kind", F.concat_ws(" ", "x.verb", "x.noun").alias("relation"))
