"""Text operators (T1-T10): tokenizers, stop words, n-grams, stems, tags.

Built-in Spark ML stages where Spark has one (JVM side); native expressions
elsewhere.  Only the Porter stemmer needs Python, and it runs once per
distinct word (Arrow batches), never once per token.
"""

from __future__ import annotations

import string

from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover, Tokenizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textflow.operators.partitioned import lookup
from textflow.session import cut_lineage

# ASCII punctuation deleted by the normalizing tokenizer
# (Python's string.punctuation), and the word splits the Treebank word
# tokenizer still makes once punctuation is gone.
PUNCTUATION = string.punctuation
SPLIT_WORDS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]


def tokenize(df: DataFrame, in_: str, out: str) -> DataFrame:
    """Lower-case, split on each whitespace character."""
    return Tokenizer(inputCol=in_, outputCol=out).transform(df)


def tokenize_regex(df: DataFrame, in_: str, out: str, pattern: str = r"\s+",
                   gaps: bool = True, min_length: int = 1, lower: bool = True) -> DataFrame:
    """Regex tokenizer (defaults: split on \\s+, keep tokens of length >= 1)."""
    return RegexTokenizer(inputCol=in_, outputCol=out, pattern=pattern, gaps=gaps,
                          minTokenLength=min_length, toLowercase=lower).transform(df)


def normalized_tokens(c) -> Column:
    """T3 as a column: lower, delete ASCII punctuation, split words, drop empties."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.translate(F.lower(c), PUNCTUATION, "")
    # one pass for all splits: groups of the alternatives that did not take
    # part are empty in the replacement
    pattern = r"\b(?:" + "|".join(f"({a})({b})" for a, b in SPLIT_WORDS) + r")\b"
    firsts = "".join(f"${2 * i + 1}" for i in range(len(SPLIT_WORDS)))
    seconds = "".join(f"${2 * i + 2}" for i in range(len(SPLIT_WORDS)))
    text = F.regexp_replace(text, pattern, f"{firsts} {seconds}")
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def normalize_tokens(df: DataFrame, in_: str, out: str, stem: bool = False) -> DataFrame:
    """Normalizing tokenizer; with ``stem`` the tokens are Porter-stemmed (T4)."""
    df = df.withColumn(out, normalized_tokens(in_))
    if stem:
        from textflow.operators.stem import stem_column
        df = stem_column(df, out, out)
    return df


def remove_stopwords(df: DataFrame, in_: str, out: str, case_sensitive: bool = False,
                     words=None) -> DataFrame:
    """T5: drop English stop words (Spark's list unless ``words`` is given)."""
    st = StopWordsRemover(inputCol=in_, outputCol=out, caseSensitive=case_sensitive)
    if words is not None:
        st.setStopWords(list(words))
    return st.transform(df)


def ngrams(df: DataFrame, in_: str, out: str, n: int = 2) -> DataFrame:
    """N-grams joined by a space; shorter input gives an empty array."""
    return NGram(n=n, inputCol=in_, outputCol=out).transform(df)


def sentences(df: DataFrame, in_: str, out: str) -> DataFrame:
    """T7 ('.' rule): the text split at every full stop."""
    return df.withColumn(out, F.split(F.col(in_), r"\.", -1))


def long_tokens(df: DataFrame, id_col: str, tokens: str, pos: str = "pos",
                token: str = "token") -> DataFrame:
    """Array column -> long form (id, pos, token)."""
    return df.select(id_col, F.posexplode(tokens).alias(pos, token))


# --- unigram tagger (T8) ------------------------------------------------------

def train_tagger(tagged: DataFrame, token: str = "token", tag: str = "tag", count: str | None = None) -> DataFrame:
    """T8 train: most frequent tag per word (ties: smallest tag) -> lexicon (token, tag).
    ``count`` names a column for how often the word was seen.

    Partial aggregation on (token, tag) first, so a frequent word never lands
    whole in one task.
    """
    counts = tagged.groupBy(token, tag).agg(F.count(F.lit(1)).alias("_c"))
    return counts.groupBy(token).agg(
        F.min_by(F.col(tag), F.struct(-F.col("_c"), F.col(tag))).alias(tag),
        *([F.sum("_c").alias(count)] if count else []))


def tag_tokens(df_long: DataFrame, lexicon: DataFrame, token: str = "token",
               tag: str = "tag", count: str | None = None) -> DataFrame:
    """T8 apply: left join the lexicon; unknown words get a null tag.  With
    ``count`` (see ``train_tagger``; from the same words, or like ones) frequent
    words are sent to the tokens, which stay where they are."""
    if count is None:
        return lookup(df_long, lexicon.select(token, tag), token, "left")
    return lookup(df_long, lexicon.select(token, tag, F.col(count).alias("_seen")), token, "left", size="_seen", twice=True).drop("_seen")


def verb_object_pairs(tagged_long: DataFrame, id_col: str = "doc_id", pos: str = "pos",
                      token: str = "token", tag: str = "tag", span: int = 4) -> DataFrame:
    """T10 (re-aimed): each verb (tag VB*) with the nearest noun (NN*) among the
    next ``span`` tokens of the same document -> (id, pos, verb, noun, relation).

    Window per document, ordered by position; a document is one row's text.
    Read backwards, the nearest noun is the last one seen; words that are
    neither verbs nor nouns only count.
    """
    back = Window.partitionBy(id_col).orderBy(F.col(pos).desc())
    verb, noun = (F.coalesce(F.col(tag).startswith(x), F.lit(False)) for x in ("VB", "NN"))
    x = tagged_long.select(id_col, pos, verb.alias("_verb"), noun.alias("_isnoun"), F.when(verb | noun, F.col(token)).alias("_t"))
    x = x.withColumn("_at", F.row_number().over(back))
    seen = F.last(F.when(F.col("_isnoun"), F.struct("_at", "_t")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("_seen", seen).where(F.col("_verb") & (F.col("_at") - F.col("_seen._at") <= span) & F.col("_seen._t").isNotNull())
    return x.select(id_col, pos, F.col("_t").alias("verb"), F.col("_seen._t").alias("noun"),
                    F.concat_ws(" ", F.col("_t"), F.col("_seen._t")).alias("relation"))


# --- stolen-property terms (T9) ------------------------------------------------------

# Headings and words of the stolen-property rule.  The
# reference's list misses a comma, so 'property' and 'police' became one entry
# 'propertypolice'; ``compat=True`` keeps that list.
PROPERTY_HEADINGS = "PROPERTY LIST SUMMARY:|PROPERTY STOLEN:"
REMOVABLE = ["modus", "operandi", "call", "with", "list", "of", "location", "point", "entry",
             "value", "property", "police", "stage", "name", "details", "insured", "victim",
             "address"]
REMOVABLE_COMPAT = [w for w in REMOVABLE if w not in ("property", "police")] + ["propertypolice"]
NOUN_TAGS = ["NN", "NNS"]


def property_text(c) -> Column:
    """T9 part 1: [] unless the text names PROPERTY; else every piece between
    property headings (the one before the first, too) up to its first ':' or
    '_', joined by blanks."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    pieces = F.split(c, PROPERTY_HEADINGS, -1)
    cut = F.transform(pieces, lambda p: F.split(p, "[:_]", -1).getItem(0))
    return F.when(c.contains("PROPERTY"), F.array_join(cut, " ")).otherwise(F.lit(None))


def stolen_terms(df: DataFrame, id_col: str, narrative: str, lexicon: DataFrame,
                 stem: bool = False, compat: bool = False, min_len: int = 3) -> DataFrame:
    """Noun terms of the stolen-property part -> long (id, pos, term).

    Normalize (T3, optional stem), tag with the unigram lexicon (T8), keep
    NN/NNS words not in the removal list and of >= ``min_len`` letters.  The
    reports' words are counted first; their entries of the lexicon, far fewer
    than it has, are sent to the tokens.
    """
    x = df.select(id_col, property_text(narrative).alias("_pt"))
    x = cut_lineage(normalize_tokens(x, "_pt", "_tok", stem=stem).select(id_col, "_tok"))  # read twice
    toks = x.select(id_col, F.posexplode("_tok").alias("pos", "token"))
    words = toks.groupBy("token").agg(F.count(F.lit(1)).alias("_rows"))
    drop = REMOVABLE_COMPAT if compat else REMOVABLE
    if stem and not compat:
        from textflow.operators.stem import porter
        drop = [porter(w) for w in drop]
    keep = (F.col("tag").isin(NOUN_TAGS) & ~F.col("token").isin(drop)
            & (F.length("token") >= min_len))
    nouns = words.join(lexicon.select("token", "tag").where(keep), "token").drop("tag")
    return lookup(toks, nouns, "token", size="_rows").select(id_col, "pos", F.col("token").alias("term"))
