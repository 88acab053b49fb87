"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or fixtures Spark derives from them)
whole.  The matching DuckDB SQL lives in ``textflow.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textflow.plans import fixtures as FX
from textflow.plans.incidents import incident_features

REGISTRY: dict = {}


def register(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@register("incident_features")
def q_incident_features(spark: SparkSession, sf: str) -> DataFrame:
    """X1-X10, T12 on every report (R4 derive, R5 fill)."""
    df = incident_features(FX.incidents(spark, sf), with_fingerprint=False)
    return df.select("incident_id", "offender", "location_code", "ordinal_date", "hour",
                     "entry_location", "entry_point", "day_of_week", "grid_key",
                     "method_of_entry", "messy", "signature", "property_secure")


# ---- linkage ------------------------------------------------------------------

def _reports(spark, sf, blank="keep", keep=("incident_id", "offender")):
    """Prepared reports, the columns that are wanted, written once to the
    shared checkpoint folder: the pair queries read them in several passes."""
    from textflow.plans.linkage import prepared_reports
    from textflow.session import cut_lineage
    return cut_lineage(prepared_reports(FX.incidents(spark, sf), blank=blank, keep=list(keep)))


@register("primary_offender")
def q_primary_offender(spark, sf):
    """K1 (with J3 counts, A3 arg-max): primary offender per narrative."""
    from textflow.plans.incidents import incident_features as feats
    from textflow.operators.linkage import primary_offender
    f = feats(FX.incidents(spark, sf)).withColumn("original_offender", F.col("offender"))
    return primary_offender(f).select("incident_id", "original_offender", "offender")


@register("primary_offender_merged")
def q_primary_offender_merged(spark, sf):
    """K1 with blank narratives merged into one fingerprint (reference rule)."""
    from textflow.plans.incidents import incident_features as feats
    from textflow.operators.linkage import primary_offender
    f = feats(FX.incidents(spark, sf)).withColumn("original_offender", F.col("offender"))
    return primary_offender(f, blank="merge").select("incident_id", "original_offender", "offender")


@register("link_stats")
def q_link_stats(spark, sf):
    """A5: groups, linked pairs, reports, draws per report, balance."""
    from textflow.operators.linkage import link_stats
    s = link_stats(_reports(spark, sf), "offender", 1)
    return s.withColumn("balance", F.round("balance", 6))


@register("positive_pairs")
def q_positive_pairs(spark, sf):
    """K2 (J4): all pairs inside each offender group, weight 1/n."""
    from textflow.operators.linkage import positive_pairs
    p = positive_pairs(_reports(spark, sf), "offender", "incident_id")
    return p.withColumn("weight", F.round("weight", 6))


@register("negative_pairs")
def q_negative_pairs(spark, sf):
    """K3 (J5): K distinct other groups per report, one report from each."""
    from textflow.operators.linkage import negative_pairs
    return negative_pairs(_reports(spark, sf), "offender", "incident_id", ratio=1, seed=0)


def _pair_features(spark, sf):
    from textflow.plans.linkage import PAIR_COLUMNS, linkage_pairs
    return linkage_pairs(_reports(spark, sf, keep=PAIR_COLUMNS))


@register("pair_features")
def q_pair_features(spark, sf):
    """K4 with D1-D7: distances and tf-idf cosines of every labelled pair."""
    p = _pair_features(spark, sf)
    return p.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes])


@register("linkage_dataset")
def q_linkage_dataset(spark, sf):
    """K5/K6 (R7, R8, F8, F9): the scaled training set, one column per slot."""
    from textflow.plans.linkage import flat_scaled, linkage_dataset
    scaled, _, names = linkage_dataset(FX.incidents(spark, sf), lexicon=_lexicon(spark, sf), senses=FX.senses(spark, sf),
                                       ancestors=FX.ancestors(spark, sf))
    return flat_scaled(scaled, names)


# ---- text on whole documents -------------------------------------------------------

def _docs(spark, sf):
    return FX.load(spark, sf, "documents").select("doc_id", "text")


@register("tokenize")
def q_tokenize(spark, sf):
    """Tokenizer, long form (doc_id, pos, token)."""
    from textflow.operators.text import long_tokens, tokenize
    return long_tokens(tokenize(_docs(spark, sf), "text", "tokens"), "doc_id", "tokens")


@register("tokenize_regex")
def q_tokenize_regex(spark, sf):
    """RegexTokenizer on \\s+, long form."""
    from textflow.operators.text import long_tokens, tokenize_regex
    return long_tokens(tokenize_regex(_docs(spark, sf), "text", "tokens"), "doc_id", "tokens")


@register("normalize_tokens")
def q_normalize_tokens(spark, sf):
    """T3 without stemming: lower, delete punctuation, split words."""
    from textflow.operators.text import long_tokens, normalize_tokens
    return long_tokens(normalize_tokens(_docs(spark, sf), "text", "tokens"), "doc_id", "tokens")


@register("remove_stopwords")
def q_remove_stopwords(spark, sf):
    """T5 after T2."""
    from textflow.operators.text import long_tokens, remove_stopwords, tokenize_regex
    x = remove_stopwords(tokenize_regex(_docs(spark, sf), "text", "raw"), "raw", "tokens")
    return long_tokens(x, "doc_id", "tokens")


@register("ngrams")
def q_ngrams(spark, sf):
    """2-grams of the T2 tokens, long form (doc_id, pos, ngram)."""
    from textflow.operators.text import long_tokens, ngrams, tokenize_regex
    x = ngrams(tokenize_regex(_docs(spark, sf), "text", "raw"), "raw", "grams", 2)
    return long_tokens(x, "doc_id", "grams", token="ngram")


@register("sentences")
def q_sentences(spark, sf):
    """T7 ('.' rule): long form (doc_id, pos, sentence)."""
    from textflow.operators.text import long_tokens, sentences
    return long_tokens(sentences(_docs(spark, sf), "text", "s"), "doc_id", "s", token="sentence")


@register("count_vector_terms")
def q_count_vector_terms(spark, sf):
    """F2 in long form: counts over the whole vocabulary."""
    from textflow.operators.features import count_vector_terms
    from textflow.operators.text import tokenize_regex
    x = tokenize_regex(_docs(spark, sf), "text", "tokens")
    return count_vector_terms(x, "doc_id", "tokens")


@register("tf_idf_terms")
def q_tf_idf_terms(spark, sf):
    """F3 in long form: exact tf, df, idf, tf-idf per (doc, term)."""
    from textflow.operators.features import tf_idf_terms
    from textflow.operators.text import tokenize_regex
    x = tokenize_regex(_docs(spark, sf), "text", "tokens")
    t = tf_idf_terms(x, "doc_id", "tokens")
    return t.select("doc_id", "term", "tf", "df", F.round("idf", 6).alias("idf"),
                    F.round("tfidf", 6).alias("tfidf"))


# ---- feature vectors ---------------------------------------------------------------

@register("index_labels")
def q_index_labels(spark, sf):
    """StringIndexer by descending frequency, ties alphabetical."""
    from textflow.operators.features import index_labels
    df, _ = index_labels(FX.load(spark, sf, "customer"), "c_mktsegment", "segment_index")
    return df.select("c_custkey", "c_mktsegment", "segment_index")


@register("one_hot")
def q_one_hot(spark, sf):
    """one-hot (last category dropped) of the order-priority index."""
    from pyspark.ml.functions import vector_to_array
    from textflow.operators.features import index_labels, one_hot
    df, _ = index_labels(FX.load(spark, sf, "orders"), "o_orderpriority", "p_index")
    df, _ = one_hot(df, "p_index", "p_vec")
    arr = vector_to_array("p_vec")
    pos = F.array_position(arr, 1.0)
    return df.select("o_orderkey", "o_orderpriority",
                     F.when(pos > 0, pos - 1).cast("int").alias("hot"),
                     F.size(arr).alias("width"))


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("assemble_minmax")
def q_assemble_minmax(spark, sf):
    """F8 + F9: VectorAssembler then MinMaxScaler, one column per slot."""
    from pyspark.ml.functions import vector_to_array
    from textflow.operators.features import assemble, scale_minmax
    li = FX.load(spark, sf, "lineitem")
    df, _ = scale_minmax(assemble(li, _NUMS, "raw"), "raw", "scaled")
    arr = vector_to_array("scaled")
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     *[F.round(arr[i], 6).alias(f"s_{c}") for i, c in enumerate(_NUMS)])


@register("standardize")
def q_standardize(spark, sf):
    """StandardScaler (unit sample deviation, no centring)."""
    from pyspark.ml.functions import vector_to_array
    from textflow.operators.features import assemble, standardize
    li = FX.load(spark, sf, "lineitem")
    df, _ = standardize(assemble(li, _NUMS, "raw"), "raw", "std")
    arr = vector_to_array("std")
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     *[F.round(arr[i], 6).alias(f"z_{c}") for i, c in enumerate(_NUMS)])


# ---- relational ------------------------------------------------------------------

@register("select_rename_drop")
def q_select_rename_drop(spark, sf):
    """R1-R3."""
    from textflow.operators.relational import drop_cols, rename, select_cols
    o = FX.load(spark, sf, "orders")
    x = select_cols(o, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return drop_cols(rename(x, o_custkey="customer"), "o_orderstatus")


@register("fill_nulls")
def q_fill_nulls(spark, sf):
    """Per-column fill values."""
    from textflow.operators.relational import fill_nulls
    return fill_nulls(FX.gaps(spark, sf), {"o_totalprice": 0.0, "priority": "UNKNOWN"})


@register("drop_nulls")
def q_drop_nulls(spark, sf):
    """R6."""
    from textflow.operators.relational import drop_nulls
    return drop_nulls(FX.gaps(spark, sf), ["o_totalprice", "priority"])


@register("fill_int_mean")
def q_fill_int_mean(spark, sf):
    """Int column filled with its half-even rounded mean."""
    from textflow.operators.features import fill_int_mean
    return fill_int_mean(FX.gaps(spark, sf), ["price_k"]).select("o_orderkey", "price_k")


@register("impute_mean")
def q_impute_mean(spark, sf):
    """Imputer (mean) on a double column."""
    from textflow.operators.features import impute_mean
    x = impute_mean(FX.gaps(spark, sf), ["o_totalprice"])
    return x.select("o_orderkey", F.round("o_totalprice_imputed", 6).alias("o_totalprice_imputed"))


@register("split_by_key")
def q_split_by_key(spark, sf):
    """R9 (replayable form): train/test label from the key."""
    from textflow.operators.relational import split_by_key
    return split_by_key(FX.load(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@register("join_on")
def q_join_on(spark, sf):
    """Orders with their customer, on a shared id column."""
    from textflow.operators.relational import join_on
    c = FX.load(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    o = FX.load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return join_on(o, c.select("o_custkey", "c_name", "c_mktsegment"), "o_custkey")


@register("join_branches")
def q_join_branches(spark, sf):
    """Three feature branches of the documents joined on doc_id."""
    from textflow.operators.relational import join_branches
    from textflow.operators.text import ngrams, tokenize_regex
    d = _docs(spark, sf)
    toks = tokenize_regex(d, "text", "tokens")
    b1 = toks.select("doc_id", F.size("tokens").alias("n_tokens"))
    b2 = ngrams(toks, "tokens", "grams", 2).select("doc_id", F.size("grams").alias("n_bigrams"))
    b3 = d.select("doc_id", F.length("text").alias("n_chars"))
    return join_branches(b1, b2, b3, id_col="doc_id")


@register("attach_count")
def q_attach_count(spark, sf):
    """Lines per order looked up onto every line."""
    from textflow.operators.linkage import attach_count
    li = FX.load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return attach_count(li, "l_orderkey", "n_lines")


@register("count_by")
def q_count_by(spark, sf):
    """A1: orders per customer."""
    from textflow.operators.linkage import count_by
    return count_by(FX.load(spark, sf, "orders"), "o_custkey", "n_orders")


@register("primary_by")
def q_primary_by(spark, sf):
    """A3: per customer, the priority of the most expensive order."""
    from textflow.operators.linkage import primary_by
    return primary_by(FX.load(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_totalprice")


@register("means")
def q_means(spark, sf):
    """A4: means of many columns in one pass."""
    from textflow.operators.relational import means
    m = means(FX.load(spark, sf, "lineitem"), _NUMS)
    return m.select(*[F.round(c, 6).alias(c) for c in _NUMS])


@register("sql_source")
def q_sql_source(spark, sf):
    """S3: SQL text over frames passed by name."""
    from textflow.sources.files import sql_source
    return sql_source(spark, """
        SELECT o.o_orderstatus, count(*) AS n_lines,
               round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey
        GROUP BY o.o_orderstatus""",
        lineitem=FX.load(spark, sf, "lineitem"), orders=FX.load(spark, sf, "orders"))


@register("table_source")
def q_table_source(spark, sf):
    """A catalog view read back by name."""
    from textflow.sources.files import table_source
    FX.load(spark, sf, "nation").createOrReplaceTempView("tf_nation")
    FX.load(spark, sf, "region").createOrReplaceTempView("tf_region")
    n, r = table_source(spark, "tf_nation"), table_source(spark, "tf_region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


@register("profile")
def q_profile(spark, sf):
    """Row count, column count, name/type pairs of lineitem."""
    from textflow.sources.profile import profile
    return profile(FX.load(spark, sf, "lineitem"))


@register("column_roles")
def q_column_roles(spark, sf):
    """Column roles of nation and part."""
    from textflow.sources.profile import column_roles
    return column_roles(FX.load(spark, sf, "nation")).unionByName(
        column_roles(FX.load(spark, sf, "part")))


@register("preview")
def q_preview(spark, sf):
    """First 100 embeddings by id, vectors cut to 10 values."""
    from textflow.sources.profile import preview
    return preview(FX.load(spark, sf, "embeddings"), 100, 10, order_by="vec_id")


# ---- learning and evaluation ------------------------------------------------------

def _labelled(spark, sf):
    d = FX.load(spark, sf, "documents").select("doc_id", "text", "n_chars")
    lab = FX.load(spark, sf, "labels")
    return d.join(lab, "doc_id").withColumn(
        "n_lines", F.size(F.split(F.col("text"), "\n", -1)).cast("double")) \
        .withColumn("score", F.col("n_chars").cast("double"))


def _one(spark, value, name):
    return spark.createDataFrame([(float(value),)], f"{name} double").select(F.round(name, 6).alias(name))


@register("auc")
def q_auc(spark, sf):
    """Exact area under ROC of document length for the quality label."""
    from textflow.operators.evaluate import auc
    return _one(spark, auc(_labelled(spark, sf), "quality", "score"), "auc")


@register("roc_points")
def q_roc_points(spark, sf):
    """ROC points per distinct score."""
    from textflow.operators.evaluate import roc_points
    r = roc_points(_labelled(spark, sf), "quality", "score")
    return r.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@register("f_by_threshold")
def q_f_by_threshold(spark, sf):
    """Precision, recall, F1 per threshold."""
    from textflow.operators.evaluate import f_by_threshold
    r = f_by_threshold(_labelled(spark, sf), "quality", "score")
    return r.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@register("compare_auc")
def q_compare_auc(spark, sf):
    """Two scores compared by AUC."""
    from textflow.operators.evaluate import compare
    d = _labelled(spark, sf)
    c = compare(spark, {"length": (d, "score"), "lines": (d, "n_lines")}, label="quality")
    return c.select("name", F.round("auc", 6).alias("auc"))


@register("measures")
def q_measures(spark, sf):
    """E5: regression RMSE / MAE and multiclass accuracy on given predictions."""
    from textflow.operators.evaluate import measure
    li = FX.load(spark, sf, "lineitem").join(FX.load(spark, sf, "part"),
                                             F.col("l_partkey") == F.col("p_partkey"))
    reg = li.select(F.col("l_extendedprice").alias("label"),
                    (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))
    lab = FX.load(spark, sf, "labels").select(F.col("quality").cast("double").alias("label"),
                                              F.col("toxic").cast("double").alias("prediction"))
    rows = [("rmse", measure(reg, "regression", "rmse")), ("mae", measure(reg, "regression", "mae")),
            ("accuracy", measure(lab, "multiclass", "accuracy"))]
    return spark.createDataFrame(rows, "metric string, value double") \
        .select("metric", F.round("value", 6).alias("value"))


@register("linear_regression")
def q_linear_regression(spark, sf):
    """M1: extended price on quantity (normal equations, exact)."""
    from textflow.operators.features import assemble
    from textflow.operators.learn import linear
    li = assemble(FX.load(spark, sf, "lineitem"), ["l_quantity"], "features")
    _, model = linear(li, label="l_extendedprice")
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                 "coefficient double, intercept double") \
        .select(F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


@register("naive_bayes")
def q_naive_bayes(spark, sf):
    """M4: class log-priors (term null) and term log-probabilities per class."""
    from textflow.operators.features import term_frequencies
    from textflow.operators.learn import naive_bayes_terms
    from textflow.operators.text import tokenize_regex
    d = tokenize_regex(_labelled(spark, sf), "text", "tokens").withColumn("label", F.col("quality").cast("int"))
    out = naive_bayes_terms(d.select("doc_id", "label"), term_frequencies(d, "doc_id", "tokens"), "doc_id")
    return out.select("label", "term", F.round("log_prob", 6).alias("log_prob"))


@register("naive_bayes_predict")
def q_naive_bayes_predict(spark, sf):
    """M4 + M5: naive Bayes applied to the labelled documents, by a join with its term table."""
    from textflow.operators.features import term_frequencies
    from textflow.operators.learn import naive_bayes_apply, naive_bayes_terms
    from textflow.operators.text import tokenize_regex
    d = tokenize_regex(_labelled(spark, sf), "text", "tokens").withColumn("label", F.col("quality").cast("int"))
    tf = term_frequencies(d, "doc_id", "tokens")
    return naive_bayes_apply(d, tf, naive_bayes_terms(d.select("doc_id", "label"), tf, "doc_id"), "doc_id")


@register("logistic_regression")
def q_logistic_regression(spark, sf):
    """M2 + M5: hashed tf-idf of labelled documents -> quality; applied to all documents."""
    from pyspark.ml.functions import vector_to_array
    from textflow.operators.features import hashing_tf, idf
    from textflow.operators.learn import apply_model, logistic
    from textflow.operators.text import tokenize_regex
    d = tokenize_regex(_labelled(spark, sf), "text", "tokens")
    d, idf_model = idf(hashing_tf(d, "tokens", "tf"), "tf", "features")
    d = d.withColumn("class", F.col("quality").cast("double")).withColumn("weight", F.lit(1.0))
    _, model = logistic(d, regParam=0.01)
    docs = tokenize_regex(FX.load(spark, sf, "documents").select("doc_id", "text"), "text", "tokens")
    docs = idf_model.transform(hashing_tf(docs, "tokens", "tf"))
    p = apply_model(model, docs)
    return p.select("doc_id", "prediction", F.round(vector_to_array("probability")[1], 6).alias("p1"))


@register("decision_tree")
def q_decision_tree(spark, sf):
    """M3: decision tree on the embedding vectors -> label."""
    from pyspark.ml.functions import array_to_vector
    from textflow.operators.learn import tree
    e = FX.load(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"))
    p, _ = tree(e)
    return p.select("vec_id", "label", "prediction")


@register("kmeans")
def q_kmeans(spark, sf):
    """M7: a stage found by name (KMeans) on the embeddings; E5 silhouette."""
    from pyspark.ml.functions import array_to_vector
    from textflow.operators.evaluate import measure
    from textflow.operators.learn import fit_apply, stage
    e = FX.load(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    p, _ = fit_apply(stage("KMeans", k=4, seed=1), e)
    sil = measure(p, "clustering", "silhouette")
    return p.select("vec_id", "prediction", F.lit(round(sil, 6)).alias("silhouette"))


@register("cross_validation")
def q_cross_validation(spark, sf):
    """M8: 3-fold search over the regularization of the quality model."""
    from pyspark import StorageLevel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from textflow.operators.features import hashing_tf
    from textflow.operators.learn import search
    from textflow.operators.text import tokenize_regex
    d = hashing_tf(tokenize_regex(_labelled(spark, sf), "text", "tokens"), "tokens", "features")
    # the search keeps its folds in memory and on disk: vectors and labels, not the texts; fitted from one pass over them
    d = d.select("features", F.col("quality").cast("double").alias("label")).persist(StorageLevel.MEMORY_AND_DISK)
    cv = search(LogisticRegression(maxIter=20), {"regParam": [0.01, 0.1]},
                BinaryClassificationEvaluator(), d, folds=3)
    d.unpersist()
    rows = [(float(p), float(m)) for p, m in zip([0.01, 0.1], cv.avgMetrics)]
    return spark.createDataFrame(rows, "reg_param double, avg_auc double")


@register("linkage_model")
def q_linkage_model(spark, sf):
    """M2 + M5 + E1 + E4 on the flagship: split the pairs, learn 'same
    offender', AUC on train and test."""
    from textflow.operators.evaluate import compare
    from textflow.operators.learn import apply_model, logistic
    from textflow.operators.relational import split
    from textflow.plans.linkage import linkage_dataset
    scaled, _, _ = linkage_dataset(FX.incidents(spark, sf))
    data = scaled.select(F.col("feature_vec").alias("features"), "weight",
                         F.col("class").cast("double").alias("class"))
    train, test = split(data, (0.9, 0.1), seed=12345)
    train_p, model = logistic(train)
    test_p = apply_model(model, test)
    return compare(spark, {"train": (train_p, "rawPrediction"), "test": (test_p, "rawPrediction")})


# ---- stems, tags, stolen terms, relations, senses ------------------------------------

@register("stems")
def q_stems(spark, sf):
    """T4: Porter stems of every document word (once per distinct word)."""
    from textflow.operators.stem import stem_vocabulary
    return stem_vocabulary(FX.tokens(spark, sf), "token")


def _lexicon(spark, sf, count=None):
    from textflow.operators.text import train_tagger
    return train_tagger(FX.tagged_tokens(spark, sf), count=count)


@register("tagger")
def q_tagger(spark, sf):
    """T8 train: most frequent tag per word."""
    return _lexicon(spark, sf)


@register("tag_tokens")
def q_tag_tokens(spark, sf):
    """T8 apply: tags of every document token (unknown -> null)."""
    from textflow.operators.text import tag_tokens
    return tag_tokens(FX.tokens(spark, sf), _lexicon(spark, sf, "seen"), count="seen")


@register("verb_object_pairs")
def q_verb_object_pairs(spark, sf):
    """T10 (re-aimed): verb + nearest following noun within 4 tokens."""
    from textflow.operators.text import tag_tokens, verb_object_pairs
    tagged = tag_tokens(FX.tokens(spark, sf), _lexicon(spark, sf, "seen"), count="seen")
    return verb_object_pairs(tagged, "doc_id", "pos", "token", "tag", span=4)


@register("verb_relations")
def q_verb_relations(spark, sf):
    """Objects and passive subjects, heads learned from the corpus by EM."""
    from textflow.operators.relations import verb_relations
    from textflow.operators.text import tag_tokens
    return verb_relations(tag_tokens(FX.tokens(spark, sf), _lexicon(spark, sf, "seen"), count="seen"), "doc_id", "pos", "token", "tag", span=4)


def _stolen(spark, sf):
    from textflow.operators.text import stolen_terms
    from textflow.session import cut_lineage
    # the callers read it several times: the tagger is trained once
    return cut_lineage(stolen_terms(FX.incidents(spark, sf), "incident_id", "narrative", _lexicon(spark, sf)))


@register("stolen_terms")
def q_stolen_terms(spark, sf):
    """Noun terms of the stolen-property part of every narrative."""
    return _stolen(spark, sf)


@register("fingerprint")
def q_fingerprint(spark, sf):
    """SHA-256 of every narrative."""
    from textflow.functions.incident import fingerprint
    i = FX.incidents(spark, sf).na.fill({"narrative": ""})
    return i.select("incident_id", fingerprint("narrative").alias("narrative_hash"))


@register("choose_sense")
def q_choose_sense(spark, sf):
    """Sense of each stolen term by gloss overlap with the report's terms."""
    from textflow.operators.senses import choose_sense
    return choose_sense(_stolen(spark, sf), FX.senses(spark, sf), "incident_id")


def _pairs(spark, sf):
    """All labelled pairs, made by the operator that reads them."""
    from textflow.operators.linkage import LabelledPairs
    return LabelledPairs(_reports(spark, sf), "offender", "incident_id")


def _sense_inputs(spark, sf):
    from textflow.operators.senses import choose_sense
    anc = FX.ancestors(spark, sf)
    depth = anc.agg(F.max("dist")).first()[0] + 1
    chosen = choose_sense(_stolen(spark, sf), FX.senses(spark, sf), "incident_id")
    return chosen, anc, depth


@register("sense_best")
def q_sense_best(spark, sf):
    """D12 (re-aimed): best-match Leacock-Chodorow similarity of every pair."""
    from textflow.operators.senses import pair_sense_best
    chosen, anc, depth = _sense_inputs(spark, sf)
    p = pair_sense_best(_pairs(spark, sf), chosen, anc, depth, "incident_id")
    return p.select("l", "r", F.round("sense_best", 6).alias("sense_best"))


@register("sense_assignment")
def q_sense_assignment(spark, sf):
    """Optimal assignment of the stolen-property senses of every pair."""
    from textflow.operators.senses import pair_sense_assignment
    chosen, anc, depth = _sense_inputs(spark, sf)
    p = pair_sense_assignment(_pairs(spark, sf), chosen, anc, depth, "incident_id")
    return p.select("l", "r", F.round("sense_assignment", 6).alias("sense_assignment"))


@register("sense_mean")
def q_sense_mean(spark, sf):
    """Mean similarity over all sense pairs of every pair."""
    from textflow.operators.senses import pair_sense_mean
    chosen, anc, depth = _sense_inputs(spark, sf)
    p = pair_sense_mean(_pairs(spark, sf), chosen, anc, depth, "incident_id")
    return p.select("l", "r", F.round("sense_mean", 6).alias("sense_mean"))


@register("pair_overlap")
def q_pair_overlap(spark, sf):
    """Stolen-term list overlap of every pair."""
    from textflow.operators.linkage import pair_overlap
    p = pair_overlap(_pairs(spark, sf), _stolen(spark, sf), "incident_id")
    return p.select("l", "r", F.round("overlap", 6).alias("overlap"))


@register("pair_overlap_idf")
def q_pair_overlap_idf(spark, sf):
    """Idf-weighted stolen-term overlap of every pair."""
    from textflow.operators.linkage import pair_overlap
    st = _stolen(spark, sf)
    n = FX.incidents(spark, sf).count()
    idf = st.groupBy("term").agg(F.count_distinct("incident_id").alias("df")) \
        .select("term", F.log(F.lit(n + 1.0) / (F.col("df") + 1)).alias("idf"))
    p = pair_overlap(_pairs(spark, sf), st, "incident_id", idf=idf)
    return p.select("l", "r", F.round("overlap", 6).alias("overlap"))


# ---- sources, user steps, stages -----------------------------------------------------

@register("read_delimited")
def q_read_delimited(spark, sf):
    """Orders written as CSV and TSV to the shared folder, read back with
    inferred types."""
    from textflow.sources.files import read_delimited, scratch_path, write_delimited
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    o = FX.load(spark, sf, "orders").select(*cols)
    outs = []
    for fmt in ("csv", "tsv"):
        path = write_delimited(o, scratch_path(spark, f"orders-{fmt}"), fmt)
        outs.append(read_delimited(spark, path, fmt).select(
            F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
            F.col("o_totalprice").cast("double"), "o_orderpriority", F.lit(fmt).alias("fmt")))
    return outs[0].unionByName(outs[1])


@register("row_id")
def q_row_id(spark, sf):
    """Dense row id by key without a one-partition window."""
    from textflow.sources.files import with_row_id
    return with_row_id(FX.load(spark, sf, "customer").select("c_custkey", "c_name"),
                       "_id", order_by="c_custkey")


@register("user_step")
def q_user_step(spark, sf):
    """A user step over named frames."""
    from textflow.operators.stages import apply_step

    def step(df, df1):
        return df.join(df1, df.o_custkey == df1.c_custkey).groupBy("c_mktsegment") \
            .agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return apply_step(step, df=FX.load(spark, sf, "orders"), df1=FX.load(spark, sf, "customer"))


@register("pipeline_stages")
def q_pipeline_stages(spark, sf):
    """Custom stages in a Pipeline: incident features, then the
    normalizing tokenizer on the method-of-entry text."""
    from pyspark.ml import Pipeline
    from textflow.operators.stages import IncidentFeatures, NormalizingTokenizer
    from textflow.operators.text import long_tokens
    pipe = Pipeline(stages=[IncidentFeatures(),
                            NormalizingTokenizer(inputCol="method_of_entry", outputCol="tokens")])
    out = pipe.fit(FX.incidents(spark, sf)).transform(FX.incidents(spark, sf))
    return long_tokens(out, "incident_id", "tokens")


# ---- learned / hashed / random results (rows-only checks) ------------------------------

@register("hashing_tf")
def q_hashing_tf(spark, sf):
    """hashed term frequencies of every document (2^18 buckets)."""
    from textflow.operators.features import hashing_tf
    from textflow.operators.text import tokenize_regex
    d = hashing_tf(tokenize_regex(_docs(spark, sf), "text", "tokens"), "tokens", "tf")
    return d.select("doc_id", F.size("tokens").alias("n_tokens"), "tf")


@register("idf_vectors")
def q_idf_vectors(spark, sf):
    """F3 as vectors: HashingTF -> IDF model -> tf-idf norm per document."""
    from textflow.operators.features import hashing_tf, idf
    from textflow.operators.text import tokenize_regex
    d = hashing_tf(tokenize_regex(_docs(spark, sf), "text", "tokens"), "tokens", "tf")
    d, _ = idf(d, "tf", "tfidf")
    return d.select("doc_id", "tfidf")


def _w2v(spark, sf):
    from textflow.operators.features import word2vec
    from textflow.operators.text import tokenize_regex
    d = tokenize_regex(_docs(spark, sf), "text", "tokens")
    return word2vec(d, "tokens", "vec", size=100, min_count=5, window=5, step=0.025,
                    iterations=1, max_sentence=1000)


@register("word2vec")
def q_word2vec(spark, sf):
    """Word2Vec; a document is the mean of its word vectors."""
    from pyspark.ml.functions import vector_to_array
    d, _ = _w2v(spark, sf)
    return d.select("doc_id", vector_to_array("vec").alias("vector"))


@register("doc_embedding")
def q_doc_embedding(spark, sf):
    """F5 (re-aimed): tf-idf weighted mean of Word2Vec word vectors."""
    from pyspark.ml.functions import vector_to_array
    from textflow.operators.features import doc_embedding, tf_idf_terms
    d, model = _w2v(spark, sf)
    wv = model.getVectors().select("word", vector_to_array("vector").alias("vector"))
    w = tf_idf_terms(d, "doc_id", "tokens")
    emb = doc_embedding(w, wv, w, "doc_id")
    return d.select("doc_id").join(emb, "doc_id", "left").select(
        "doc_id", "embedding")


@register("pca")
def q_pca(spark, sf):
    """PCA of the embeddings to 3 dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from textflow.operators.features import reduce_dims
    e = FX.load(spark, sf, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    p, _ = reduce_dims(e, "features", "pc", 3)
    return p.select("vec_id", vector_to_array("pc").alias("pc"))


# ---- learned stages whose result has a closed form ---------------------------------

@register("logistic_odds")
def q_logistic_odds(spark, sf):
    """M2: unregularized logistic regression on one binary feature: its coefficient is the log odds ratio."""
    from textflow.operators.features import assemble
    from textflow.operators.learn import logistic
    o = FX.load(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("double").alias("class"),
        (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"), F.lit(1.0).alias("weight"))
    _, model = logistic(assemble(o, ["urgent"], "features"), regParam=0.0, tol=1e-9, standardization=False)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coefficient double, intercept double") \
        .select(F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


@register("tree_majority")
def q_tree_majority(spark, sf):
    """M3: a tree on the one-hot line number predicts the commonest return flag of each number."""
    from textflow.operators.features import assemble, index_labels
    from textflow.operators.learn import tree
    li = FX.load(spark, sf, "lineitem").select("l_linenumber", "l_returnflag")
    li, index = index_labels(li, "l_returnflag", "label")
    numbers = [F.when(F.col("l_linenumber") == k, 1.0).otherwise(0.0).alias(f"n{k}") for k in range(1, 8)]
    x = assemble(li.select("l_linenumber", "label", *numbers), [f"n{k}" for k in range(1, 8)], "features")
    p, _ = tree(x, maxDepth=8)
    flag = F.element_at(F.array(*[F.lit(v) for v in index.labels]), F.col("prediction").cast("int") + 1)
    return p.select("l_linenumber", flag.alias("predicted")).distinct()


@register("pca_variance")
def q_pca_variance(spark, sf):
    """shares of variance of the two principal components of quantity and tax in percent."""
    from textflow.operators.features import assemble, reduce_dims
    li = FX.load(spark, sf, "lineitem").select("l_quantity", (F.col("l_tax") * 100).alias("tax"))
    _, model = reduce_dims(assemble(li, ["l_quantity", "tax"], "features"), "features", "pc", 2)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance)]
    return spark.createDataFrame(rows, "component int, share double").select("component", F.round("share", 6).alias("share"))


@register("model_round_trip")
def q_model_round_trip(spark, sf):
    """A linear model saved to the shared folder and loaded again."""
    import uuid

    from pyspark.ml.regression import LinearRegressionModel
    from textflow.operators.features import assemble
    from textflow.operators.learn import linear
    from textflow.session import checkpoint_dir
    from textflow.sources.files import load_model, save_model
    li = assemble(FX.load(spark, sf, "lineitem"), ["l_quantity"], "features")
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    save_model(linear(li, label="l_extendedprice")[1], path)
    model = load_model(LinearRegressionModel, path)
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "coefficient double, intercept double") \
        .select(F.round("coefficient", 4).alias("coefficient"), F.round("intercept", 4).alias("intercept"))


@register("arff_lines")
def q_arff_lines(spark, sf):
    """The data lines of an ARFF export, as read back from its files."""
    import uuid

    from textflow.operators.features import assemble
    from textflow.session import checkpoint_dir
    from textflow.sources.files import write_arff
    li = FX.load(spark, sf, "lineitem").select("l_quantity", "l_discount", F.lit(1.0).alias("weight"), (F.col("l_linenumber") % 2).alias("class"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/arff-{uuid.uuid4().hex}"
    write_arff(assemble(li, ["l_quantity", "l_discount"], "feature_vec"), path, ["l_quantity", "l_discount", "class"])
    return spark.read.text(f"{path}/data").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@register("cached")
def q_cached(spark, sf):
    """A cached frame read twice: orders of each customer above the mean price."""
    from textflow.sources.files import cached
    o = cached(FX.load(spark, sf, "orders").select("o_custkey", "o_totalprice"))
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    return (o.join(F.broadcast(mean), F.col("o_totalprice") > F.col("m")).groupBy("o_custkey")
            .agg(F.count(F.lit(1)).alias("n")))


@register("random_split")
def q_random_split(spark, sf):
    """randomSplit 0.9 / 0.1, seed 12345."""
    from textflow.operators.relational import split
    train, test = split(FX.load(spark, sf, "orders").select("o_orderkey"), (0.9, 0.1), 12345)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@register("sample")
def q_sample(spark, sf):
    """Bernoulli sample, fraction 0.5, seed 1 (the sample is the feature)."""
    from textflow.operators.relational import sample
    return sample(FX.load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), False, 0.5, 1)


def _sentence_tokens(spark, sf):
    from textflow.operators.sentences import sentence_tokens
    return sentence_tokens(_docs(spark, sf), "doc_id", "text")


@register("abbreviations")
def q_abbreviations(spark, sf):
    """T7 train: counts and abbreviation score of every word before a full stop."""
    from textflow.operators.sentences import abbreviations
    return abbreviations(_sentence_tokens(spark, sf)).withColumn("score", F.round("score", 6) + F.lit(0.0))  # no -0.0


@register("sentence_starters")
def q_sentence_starters(spark, sf):
    """T7 train: words that follow a sentence's end more often than chance."""
    from textflow.operators.sentences import abbreviations, is_abbreviation, sentence_starters
    tokens = _sentence_tokens(spark, sf)
    known = abbreviations(tokens).where(is_abbreviation()).select("word")
    return sentence_starters(tokens, known, "doc_id").withColumn("score", F.round("score", 4))


@register("trained_sentences")
def q_trained_sentences(spark, sf):
    """T7 apply: sentences of every document by the trained splitter."""
    from textflow.operators.sentences import trained_sentences
    return trained_sentences(_docs(spark, sf), "doc_id", "text")


@register("cooccurrence_pmi")
def q_cooccurrence_pmi(spark, sf):
    """counts and pointwise mutual information of words at most 4 tokens apart."""
    from textflow.operators.vectors import cooccurrences, pmi
    return pmi(cooccurrences(FX.tokens(spark, sf)), "word", "context").withColumn("pmi", F.round("pmi", 6))


@register("document_pmi")
def q_document_pmi(spark, sf):
    """shifted pointwise mutual information of documents and words, the table that is factorised."""
    from textflow.operators.vectors import pmi
    counts = FX.tokens(spark, sf).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return pmi(counts, "doc_id", "token", shift=2.0).withColumn("pmi", F.round("pmi", 6))


@register("document_vectors")
def q_document_vectors(spark, sf):
    """vectors of documents by alternating least squares on their shifted PMI with words."""
    from textflow.operators.vectors import document_vectors
    return document_vectors(FX.tokens(spark, sf), k=16, shift=2.0)[0]


@register("word_vectors")
def q_word_vectors(spark, sf):
    """word vectors from co-occurrence PMI by block power iteration, no vocabulary on the driver."""
    from textflow.operators.vectors import word_vectors
    return word_vectors(FX.tokens(spark, sf), k=8)


@register("wide_components")
def q_wide_components(spark, sf):
    """variances of the 4 leading principal components of the tf-idf table, every term a column."""
    from textflow.operators.features import tf_idf_terms
    from textflow.operators.vectors import wide_components
    from textflow.operators.text import tokenize_regex
    docs = tokenize_regex(_docs(spark, sf), "text", "tokens")
    weights = tf_idf_terms(docs, "doc_id", "tokens").select("doc_id", "term", "tfidf")
    return wide_components(weights, "doc_id", "term", "tfidf", docs.select("doc_id"), 4)[0]


@register("sample_by_key")
def q_sample_by_key(spark, sf):
    """Half of the orders by a hash of their key, without replacement."""
    from textflow.operators.sampling import sample_by_key
    return sample_by_key(FX.load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.5, 1)


@register("sample_with_replacement")
def q_sample_with_replacement(spark, sf):
    """Orders drawn with replacement (Poisson counts of mean 0.75)."""
    from textflow.operators.sampling import sample_with_replacement
    return sample_with_replacement(FX.load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.75, 1)


@register("sample_exactly")
def q_sample_exactly(spark, sf):
    """Exactly 1,000 orders (the size is the feature)."""
    from textflow.operators.sampling import sample_exactly
    return sample_exactly(FX.load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 1)


@register("ridge_search")
def q_ridge_search(spark, sf):
    """M8 (M1): error of every fold and penalty of a ridge model of extended price on quantity and discount."""
    from textflow.operators.search import ridge_search
    li = FX.load(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("discount"), (F.col("l_extendedprice") / 1000).alias("price"),
                                               ((F.col("l_orderkey") * 31 + F.col("l_linenumber")) % 3).cast("int").alias("fold"))
    table, _, _ = ridge_search(li, ["l_quantity", "discount"], "price", [0.0, 1.0, 100.0], "fold")
    return table.select("fold", "penalty", F.round("intercept", 5).alias("intercept"), F.round(F.col("coefficients")[0], 5).alias("quantity"),
                        F.round(F.col("coefficients")[1], 5).alias("discount"), F.round("mse", 4).alias("mse"))


# ---- streaming, stemmed linkage, relation cosines --------------------------------------

@register("streaming_incident_features")
def q_streaming_incident_features(spark, sf):
    """Streaming: report files -> readStream -> X1-X10/T12 -> parquet sink
    (availableNow, checkpoint in the shared folder) -> the sink read back."""
    import os
    from textflow.sources.files import scratch_path
    from textflow.streaming import stream_incident_features, stream_reports, write_stream
    base = scratch_path(spark, "stream")
    inc = FX.incidents(spark, sf)
    inc.write.mode("overwrite").parquet(os.path.join(base, "in"))
    s = stream_reports(spark, os.path.join(base, "in"), inc.schema)
    q = write_stream(stream_incident_features(s), os.path.join(base, "out"), os.path.basename(base))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    return out.select("incident_id", "offender", "location_code", "ordinal_date", "hour",
                      "entry_location", "entry_point", "day_of_week", "grid_key",
                      "method_of_entry", "messy", "signature", "property_secure")


@register("linkage_dataset_stemmed")
def q_linkage_dataset_stemmed(spark, sf):
    """K6 with Porter-stemmed method-of-entry terms (T4 inside the cosines)."""
    from textflow.plans.linkage import flat_scaled, linkage_dataset
    scaled, _, names = linkage_dataset(FX.incidents(spark, sf), stem=True)
    return flat_scaled(scaled, names)


@register("cosine_relations")
def q_cosine_relations(spark, sf):
    """Cosine of the verb-object relation tf-idf vectors of every pair
    (relations of the method-of-entry text, T10 on the T8 tagger)."""
    from textflow.operators.features import term_vectors, tf_idf_terms
    from textflow.operators.linkage import LabelledPairs, pair_cosine
    from textflow.operators.text import normalize_tokens, tag_tokens, verb_object_pairs
    from textflow.operators.text import train_tagger
    rep = _reports(spark, sf, keep=("incident_id", "offender", "method_of_entry"))
    toks = normalize_tokens(rep.select("incident_id", "method_of_entry"), "method_of_entry", "t")
    long = toks.select("incident_id", F.posexplode("t").alias("pos", "token"))
    # the tagger also learns the narrative words: '-ed' words as past-tense
    # verbs (VBD), the others as nouns
    narr = long.select("token", F.when(F.col("token").endswith("ed"), F.lit("VBD"))
                       .otherwise(F.lit("NN")).alias("tag"))
    lexicon = train_tagger(FX.tagged_tokens(spark, sf).unionByName(narr))
    rel = verb_object_pairs(tag_tokens(long, lexicon), "incident_id", "pos", "token", "tag")
    terms = rel.groupBy("incident_id").agg(F.collect_list("relation").alias("rels"))
    docs = rep.select("incident_id").join(terms, "incident_id", "left") \
        .withColumn("rels", F.coalesce("rels", F.array().cast("array<string>")))
    vec = term_vectors(tf_idf_terms(docs, "incident_id", "rels"), "incident_id")
    p = pair_cosine(LabelledPairs(rep, "offender", "incident_id"), vec, "incident_id", "cosine_mo")
    return p.select("l", "r", F.round("cosine_mo", 6).alias("cosine_mo"))
