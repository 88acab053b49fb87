"""K6: the full linkage job as one Spark plan up to each model fit.

reports -> incident features (X11) -> primary offender (K1) -> positive pairs
(K2) + negative pairs (K3) -> pair distances, tf-idf cosines and the sense
assignment of stolen property (K4, D1-D7, D12) -> missing values, assembly, min-max scaling (K5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.operators import linkage as K
from textflow.operators.features import term_vectors, tf_idf_terms
from textflow.operators.partitioned import lookup, position_index
from textflow.operators.senses import choose_sense, number_senses, sense_lists
from textflow.operators.text import ngrams, normalize_tokens, remove_stopwords, stolen_terms
from textflow.plans.incidents import incident_features
from textflow.session import cut_lineage

ID = "incident_id"
#: What pairs and their features need of a report.
PAIR_COLUMNS = list(dict.fromkeys([ID, "offender", *(c for _, _, cs in K.DISTANCES for c in cs), "method_of_entry"]))


def method_terms(reports: DataFrame, text: str = "method_of_entry", stem: bool = False) -> DataFrame:
    """Cleaned unigram and bigram token arrays of the method-of-entry text
    (normalizing tokenizer, English stop words removed, 2-grams)."""
    x = normalize_tokens(reports.select(ID, text), text, "_tok", stem=stem)
    x = remove_stopwords(x, "_tok", "tokens")
    return ngrams(x, "tokens", "bigrams", 2).select(ID, "tokens", "bigrams")


def prepared_reports(raw: DataFrame, blank: str = "keep", fix_noon: bool = False, keep=None) -> DataFrame:
    """X11 + K1: feature columns and the primary offender of every report.

    ``keep``: the columns that are wanted.  Then only these are written for K1,
    which reads them three times, with the fingerprint and the first letter of
    the narrative, which tells whether it is blank."""
    feats = incident_features(raw, fix_noon=fix_noon)
    if keep is None:
        return K.primary_offender(feats, blank=blank)
    rest = [c for c in dict.fromkeys([*keep, "offender"])]
    feats = feats.select(*rest, F.unhex("narrative_hash").alias("_mark"), F.substring("narrative", 1, 1).alias("_blank"))
    return K.primary_offender(cut_lineage(feats), "_mark", narrative="_blank", blank=blank).select(*keep)


def property_senses(raw: DataFrame, lexicon: DataFrame, senses: DataFrame, ancestors: DataFrame) -> tuple:
    """T9 -> D11 -> meet index of D12: the sense lists of every report's stolen
    property, the ancestors and distances by sense number, and the depth."""
    stolen = cut_lineage(stolen_terms(raw, ID, "narrative", lexicon))
    chosen = choose_sense(stolen, senses, ID)
    named, above, dist = number_senses(ancestors)
    return sense_lists(chosen, named, ID), above, dist, int(dist.max(initial=0)) + 1


def linkage_pairs(reports: DataFrame, ratio: int = 1, seed: int = 0,
                  stem: bool = False, property: tuple | None = None) -> DataFrame:
    """K2 + K3 + K4: labelled pairs with one distance column per feature.
    ``property``: what ``property_senses`` returns; adds the similarity of
    stolen property."""
    pairs = K.LabelledPairs(reports, "offender", ID, ratio=ratio, seed=seed)
    return K.pair_table(pairs, reports, method_vectors(reports, stem=stem), ["cosine_tfidf", "cosine_tfidf2"], ID, property_senses=property)


def method_vectors(reports: DataFrame, stem: bool = False) -> DataFrame:
    """Per report: the unigram and the bigram tf-idf vectors of the
    method-of-entry text (map of hashed term -> weight, and L2 norm), from ONE
    tf-idf pass: unigrams never hold a blank and bigrams always do, so the two
    vocabularies share one document-frequency table without mixing.

    Terms are numbered.  A cosine sums tf of the left times tf and the squared
    idf of the right report: _f0 and _f1 (number -> tf) are what a pair's left
    report needs, _t0 and _t1 (number -> tf-idf times idf) what its right does."""
    terms = method_terms(reports, stem=stem)
    both = terms.select(ID, F.concat("tokens", "bigrams").alias("terms"))
    w = tf_idf_terms(both, ID, "terms").withColumn("_bi", F.col("term").contains(" "))
    w = cut_lineage(w)  # read twice
    known = position_index(w.groupBy("term").agg(F.max("df").alias("_rows")).withColumn("_h", F.xxhash64("term")), "_h", name="_k")
    w = lookup(w, known.select("term", "_rows", F.col("_k").cast("int").alias("_k")), "term", size="_rows")
    sq = F.col("tfidf") * F.col("tfidf")

    def by_number(value, kind):
        return F.map_from_entries(F.array_sort(F.collect_list(F.when(kind, F.struct(F.col("_k").alias("k"), value.alias("v"))))))

    aggs = []
    for i, kind in enumerate((~F.col("_bi"), F.col("_bi"))):
        aggs += [by_number(F.col("tf").cast("int"), kind).alias(f"_f{i}"), by_number(F.col("tfidf") * F.col("idf"), kind).alias(f"_t{i}"),
                 F.sqrt(F.sum(F.when(kind, sq))).alias(f"_n{i}")]
    return w.groupBy(ID).agg(*aggs)


def linkage_dataset(raw: DataFrame, ratio: int = 1, blank: str = "keep", seed: int = 0,
                    stem: bool = False, checkpoint: bool = True, lexicon: DataFrame | None = None,
                    senses: DataFrame | None = None, ancestors: DataFrame | None = None):
    """K6: -> (scaled, raw_features, feature_names).  With a tagger lexicon
    and a sense inventory (``lexicon``, ``senses``, ``ancestors``) all twelve
    features; without them the similarity of stolen property is left out.

    ``scaled``: l, r, raw_feature_vec, weight, class, feature_vec.  The pair
    table feeds three fits (int means, imputer, scaler), so it is written
    once to the shared checkpoint folder instead of being recomputed.
    """
    reports = prepared_reports(raw, blank=blank, keep=PAIR_COLUMNS)
    if checkpoint:
        # read by several passes (statistics, pairs, term vectors)
        reports = cut_lineage(reports)
    property = property_senses(raw, lexicon, senses, ancestors) if senses is not None else None
    pairs = linkage_pairs(reports, ratio=ratio, seed=seed, stem=stem, property=property)
    if checkpoint:
        pairs = cut_lineage(pairs)
    return K.finish_features(pairs)


def flat_scaled(scaled: DataFrame, names) -> DataFrame:
    """Scaled vectors as one rounded column per feature (for checks and export)."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col("feature_vec"))
    cols = [F.round(arr[i], 6).alias("s_" + n.replace("_imputed", "")) for i, n in enumerate(names)]
    return scaled.select("l", "r", F.round("weight", 6).alias("weight"), "class", *cols)
