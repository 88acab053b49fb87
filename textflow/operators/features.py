"""Feature-vector operators (F1-F11) and the long-form tf-idf used for pair cosines."""

from __future__ import annotations

from pyspark.ml.feature import (IDF, PCA, CountVectorizer, HashingTF, Imputer, MinMaxScaler,
                                OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textflow.operators.partitioned import lookup
from textflow.operators.word2vec import word2vec  # noqa: F401 (F4)
from textflow.session import cut_lineage

#: Numbers of word vectors that tasks may be sent (8 bytes each).
VECTOR_CELLS = 20_000_000


def hashing_tf(df: DataFrame, in_: str, out: str, num_features: int = 1 << 18,
               binary: bool = False) -> DataFrame:
    """hashed term frequencies."""
    return HashingTF(inputCol=in_, outputCol=out, numFeatures=num_features,
                     binary=binary).transform(df)


def count_vectors(df: DataFrame, in_: str, out: str, min_df: float = 1.0,
                  vocab_size: int | None = None, binary: bool = False):
    """count vectors over a learned vocabulary -> (frame, model).

    The vocabulary is a driver-side array, as Spark's model keeps it;
    ``vocab_size`` cuts it to the most frequent terms, None keeps every term.
    For vocabularies beyond a driver see ``count_vector_terms``."""
    vocab_size = vocab_size or (1 << 31) - 1
    model = CountVectorizer(inputCol=in_, outputCol=out, minDF=min_df, vocabSize=vocab_size,
                            binary=binary).fit(df)
    return model.transform(df), model


def idf(df: DataFrame, in_: str, out: str, min_doc_freq: int = 0):
    """IDF ln((N+1)/(df+1)) times tf -> (frame, model)."""
    model = IDF(inputCol=in_, outputCol=out, minDocFreq=min_doc_freq).fit(df)
    return model.transform(df), model


def term_frequencies(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """Long form (id, term, tf) of an array<string> column."""
    return (df.select(id_col, F.explode(tokens).alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("tf")))


def tf_idf_terms(df: DataFrame, id_col: str, tokens: str, min_doc_freq: int = 0) -> DataFrame:
    """F3 in long form: (id, term, tf, df, idf, tfidf), exact (no hashing).

    N counts every row of ``df`` (empty documents too), as Spark's IDF does.
    Document frequencies are a partial aggregation; the rows of very common
    words are salted in the join back on term.
    """
    n_docs = df.count()  # one scalar
    # read twice (document frequencies, and the join back): written once to
    # the shared checkpoint folder instead of tokenizing the input twice
    tf = cut_lineage(term_frequencies(df, id_col, tokens))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    dfreq = dfreq.withColumn(
        "idf", F.when(F.col("df") >= min_doc_freq,
                      F.log(F.lit(float(n_docs + 1)) / (F.col("df") + 1))).otherwise(F.lit(0.0)))
    return (lookup(tf, dfreq.select("term", "df", "idf"), "term", size="df", twice=True)
            .withColumn("tfidf", F.col("tf") * F.col("idf")))


def term_vectors(weights: DataFrame, id_col: str, weight: str = "tfidf",
                 hashed: bool = True) -> DataFrame:
    """Long (id, term, weight) -> one row per id: a terms map and its L2 norm.

    With ``hashed`` the map keys are 64-bit xxhash64 values of the terms
    instead of the strings: a smaller shuffle payload, and a collision
    (chance about V^2 / 2^65 for V distinct terms) is far rarer than in the
    2^18-bucket hashed vectors the cosine features were defined on.
    """
    key = F.xxhash64("term") if hashed else F.col("term")
    return weights.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col(weight).alias("v"))))
        .alias("terms"),
        F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


def doc_embedding(tokens_long: DataFrame, word_vectors: DataFrame, weights: DataFrame,
                  id_col: str = "doc_id") -> DataFrame:
    """F5 (re-aimed): tf-idf weighted mean of word vectors per document.

    ``word_vectors``: (word, vector array<double>) e.g. from WordVectors.getVectors;
    ``weights``: long (id, term, tfidf).  Vectors have one length; each of
    their numbers is a sum of its own, so a term of a document is one row.
    """
    wv = cut_lineage(word_vectors.select(F.col("word").alias("term"), F.col("vector").alias("_v")))
    held = wv.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
    dim = max(held["dim"] or 0, 0)
    weights = weights.select(id_col, "term", "tfidf").repartition(id_col)
    # a document's terms lie together, so that its sums are complete in one task
    if held["n"] * dim <= VECTOR_CELLS:
        x = weights.join(F.broadcast(wv), "term")
    else:
        x = lookup(weights, wv, "term")
    at = [F.get("_v", F.lit(i)) for i in range(dim)]
    s = x.groupBy(id_col).agg(*[F.sum(F.col("tfidf") * v).alias(f"_s{i}") for i, v in enumerate(at)],
                              F.sum("tfidf").alias("_w"))
    means = F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dim)]) if dim else F.array().cast("array<double>")
    return s.select(id_col, means.alias("embedding"))


def index_labels(df: DataFrame, in_: str, out: str):
    """string -> index by descending frequency (ties alphabetical) -> (frame, model)."""
    model = StringIndexer(inputCol=in_, outputCol=out, stringOrderType="frequencyDesc").fit(df)
    return model.transform(df), model


def one_hot(df: DataFrame, in_: str, out: str, drop_last: bool = True):
    """one-hot of an index column -> (frame, model)."""
    model = OneHotEncoder(inputCols=[in_], outputCols=[out], dropLast=drop_last).fit(df)
    return model.transform(df), model


def assemble(df: DataFrame, cols, out: str, handle_invalid: str = "error") -> DataFrame:
    """F8: columns -> one vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def scale_minmax(df: DataFrame, in_: str, out: str):
    """min-max to [0, 1]; a constant feature gives 0.5 -> (frame, model)."""
    model = MinMaxScaler(inputCol=in_, outputCol=out).fit(df)
    return model.transform(df), model


def standardize(df: DataFrame, in_: str, out: str, with_mean: bool = False,
                with_std: bool = True):
    """standard scaler (sample standard deviation) -> (frame, model)."""
    model = StandardScaler(inputCol=in_, outputCol=out, withMean=with_mean,
                           withStd=with_std).fit(df)
    return model.transform(df), model


def reduce_dims(df: DataFrame, in_: str, out: str, k: int):
    """PCA to k dimensions -> (frame, model)."""
    model = PCA(k=k, inputCol=in_, outputCol=out).fit(df)
    return model.transform(df), model


def fill_int_mean(df: DataFrame, cols) -> DataFrame:
    """Fill integer columns with their mean rounded half-to-even.

    One aggregation pass gives one scalar per column (a fixed-size result); an
    all-null column stays null.
    """
    cols = list(cols)
    if not cols:
        return df
    row = df.agg(*[F.bround(F.avg(c), 0).alias(c) for c in cols]).first().asDict()
    fills = {c: int(v) for c, v in row.items() if v is not None}
    return df.na.fill(fills) if fills else df


def impute_mean(df: DataFrame, cols, suffix: str = "_imputed", drop: bool = True) -> DataFrame:
    """Mean imputation of double columns (null and NaN are missing) with
    Spark's Imputer; writes <c>_imputed and drops <c>."""
    cols = list(cols)
    if not cols:
        return df
    model = Imputer(inputCols=cols, outputCols=[c + suffix for c in cols]).fit(df)
    out = model.transform(df)
    return out.drop(*cols) if drop else out



def count_vector_terms(df: DataFrame, id_col: str, tokens: str, min_df: float = 1.0,
                       vocab_size: int | None = None, binary: bool = False) -> DataFrame:
    """F2 in long form: (id, term, tf) over the vocabulary CountVectorizer
    would learn (terms in >= min_df documents -- a fraction if < 1), computed
    as joins instead of a driver-side vocabulary.  Every term is kept unless
    ``vocab_size`` asks for the most frequent; ties at that cut go to the
    smaller term."""
    tf = term_frequencies(df, id_col, tokens)
    if binary:
        tf = tf.withColumn("tf", F.lit(1.0))
    if vocab_size is None and 0 < min_df <= 1 and float(min_df).is_integer():
        return tf  # every term is in one document at least
    tf = cut_lineage(tf)  # read twice
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df"), F.sum("tf").alias("_tot"))
    if min_df < 1.0:
        threshold = F.lit(min_df * df.count())
    else:
        threshold = F.lit(min_df)
    stats = stats.where(F.col("_df") >= threshold)
    if vocab_size is not None:
        stats = stats.orderBy(F.desc("_tot"), "term").limit(vocab_size)
    return lookup(tf, stats.select("term", "_df"), "term", size="_df").select(id_col, "term", "tf")
