"""Sentence splitting trained on the corpus itself.

Which words end in a full stop because they are abbreviations, and which words
begin sentences, are learned without labels from counts (Kiss and Strunk,
2006): all statistics are aggregations by word, and applying them is a lookup
by word and a running sum inside each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textflow.operators.partitioned import BROADCAST_KEYS, lookup
from textflow.session import cut_lineage

# The thresholds of the published method.
ABBREVIATION_SCORE, STARTER_SCORE = 0.3, 30.0

#: A token's word: lower case, without the marks around it and one final full stop.
_WORD = "regexp_replace(regexp_replace(lower({t}), '[)\\\\]\"'']+$', ''), '[.]$', '')"
_ENDS = "regexp_replace({t}, '[)\\\\]\"'']+$', '')"


#: Whether a token begins with a capital, marks before it aside.
_CAPITAL = r"{t} rlike '^[(\\[\"\']*\\p{{Lu}}'"


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tokens): the tokens between white space of every text in one array.
    Texts that repeat an id are one document, token by token."""
    split = F.expr(f"filter(split(coalesce(`{text_col}`, ''), '\\\\s+'), x -> x <> '')")
    parts = df.select(F.col(id_col), split.alias("t")).where("size(t) > 0").groupBy(id_col).agg(F.collect_list("t").alias("parts"))
    merged = "transform(array_sort(flatten(transform(parts, p -> transform(p, (t, i) -> named_struct('i', i, 't', t))))), x -> x.t)"
    return parts.select(id_col, F.expr(f"CASE WHEN size(parts) = 1 THEN parts[0] ELSE {merged} END").alias("tokens"))


def _long(documents: DataFrame, id_col: str) -> DataFrame:
    """The tokens of ``_documents`` in long form, each with the word that
    follows and whether it begins with a capital, from the row that holds both."""
    x = documents.select(id_col, "tokens", F.posexplode("tokens").alias("pos", "token"))
    x = x.select(id_col, "pos", "token", F.expr("get(tokens, pos + 1)").alias("_next"))
    return x.select(id_col, "pos", "token", F.expr(_WORD.format(t="token")).alias("word"),
                    F.regexp_extract(F.expr(_ENDS.format(t="token")), "([.!?])$", 1).alias("mark"),
                    F.expr(_WORD.format(t="_next")).alias("next_word"), F.expr(_CAPITAL.format(t="_next")).alias("next_capital"))


def sentence_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, token, word, mark, next_word, next_capital): tokens between
    white space in their order; ``mark`` is '.', '!' or '?' if the token ends
    so (closing quotes and brackets aside), '' if not; the word that follows in
    the document, and whether it begins with a capital (null at the end).  Null
    and blank texts have none."""
    return _long(_documents(df, id_col, text_col), id_col)


def _log_likelihood(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's ratio for two events: ``both`` together, each alone, of ``total``."""
    p, p1 = second / total, both / first
    p2 = (second - both) / (total - first)

    def part(k: Column, n: Column, x: Column) -> Column:
        one = F.when((x > 0) & (k > 0), k * F.log(x)).otherwise(0.0)
        return one + F.when((x < 1) & (n > k), (n - k) * F.log(1 - x)).otherwise(0.0)

    rest, others = second - both, total - first
    return -2 * (part(both, first, p) + part(rest, others, p) - part(both, first, p1) - part(rest, others, p2))


def abbreviations(tokens: DataFrame) -> DataFrame:
    """(word, with_stop, without, score) of every word that stands before a
    full stop: the log-likelihood that it nearly always does, scaled by its
    inner full stops, its length, and how often it stands without one.  A word
    is an abbreviation if its score is ABBREVIATION_SCORE or more and it has a letter."""
    words = tokens.where("word <> ''").groupBy("word").agg(
        F.count_if(F.col("mark") == ".").alias("with_stop"), F.count_if(F.col("mark") != ".").alias("without"))
    words = cut_lineage(words)
    all_ = words.agg(F.sum("with_stop").alias("stops"), F.sum(F.col("with_stop") + F.col("without")).alias("n")).first()
    share = min(max((all_.stops or 0) / max(all_.n or 0, 1), 1e-9), 1 - 1e-9)
    size = F.length(F.regexp_replace("word", "[.]", ""))
    null = F.col("with_stop") * F.log(F.lit(share)) + F.col("without") * F.log(F.lit(1 - share))
    other = F.col("with_stop") * F.log(F.lit(0.99)) + F.col("without") * F.log(F.lit(0.01))
    inner = F.length("word") - size + 1
    score = 2 * (other - null) * inner * F.exp(-size) * F.pow(F.greatest(size, F.lit(1)), -F.col("without"))
    return words.where("with_stop > 0").select("word", "with_stop", "without", score.alias("score"))


def is_abbreviation() -> Column:
    return (F.col("score") >= ABBREVIATION_SCORE) & F.col("word").rlike(r"\p{L}")


def _with_next(tokens: DataFrame, id_col: str) -> DataFrame:
    """Each token with the word that follows and whether it begins with a capital."""
    w = Window.partitionBy(id_col).orderBy("pos")
    return tokens.withColumn("next_word", F.lead("word").over(w)).withColumn("next_capital", F.lead(F.col("token").rlike(r"^[(\[\"']*\p{Lu}")).over(w))


def sentence_starters(tokens: DataFrame, known: DataFrame, id_col: str) -> DataFrame:
    """(word, at_start, n, score) of words that follow a sentence's end more
    often than chance: the log-likelihood of a word and an end before it.  An
    end is a mark of a token that is no abbreviation (``known``: (word)).

    Everything is counted by word inside the tasks first; tokens without the
    word that follows (``sentence_tokens`` gives it) get it by a window."""
    if "next_word" not in tokens.columns:
        tokens = _with_next(tokens, id_col)
    known = known.select("word").distinct()
    counts = cut_lineage(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") != "").alias("_marked")))
    n = F.lit(float(counts.agg(F.sum("n")).first()[0] or 0))
    ends = F.lit(float(counts.join(known, "word", "left_anti").agg(F.sum("_marked")).first()[0] or 0))
    after = tokens.where("mark <> '' and next_word <> ''").groupBy("word", "next_word").agg(F.count(F.lit(1)).alias("at_start")).join(known, "word", "left_anti")
    after = after.groupBy(F.col("next_word").alias("word")).agg(F.sum("at_start").alias("at_start"))
    both = after.join(counts.select("word", "n"), "word")
    more = F.col("at_start") / ends > F.col("n") / n
    score = _log_likelihood(F.col("at_start").cast("double"), ends, F.col("n").cast("double"), n)
    return both.where(more).select("word", "at_start", "n", score.alias("score"))


def trained_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """T7 (trained): (id, n, sentence): the sentences of every text from 0, their
    tokens joined by single spaces.

    A sentence ends at a token with a mark.  A full stop does not end it after
    an abbreviation or a single letter, unless the next token begins with a
    capital and its word is a frequent sentence starter; nor after a number,
    unless the next token begins with a capital.  The end of a text ends a
    sentence; a null or blank text has none.

    Documents stay rows of tokens: only tokens with a mark are looked up, and
    a document's array is cut at the ends found."""
    documents = cut_lineage(_documents(df, id_col, text_col))
    tokens = _long(documents, id_col)
    short = cut_lineage(abbreviations(tokens).where(is_abbreviation()).select("word"))
    starters = cut_lineage(sentence_starters(tokens, short, id_col).where(F.col("score") >= STARTER_SCORE).select(F.col("word").alias("next_word"), F.lit(True).alias("_starter")))
    rows = tokens.where("mark <> ''").select(id_col, "pos", "word", "mark", "next_word", "next_capital")
    for table, key in ((short.withColumn("_short", F.lit(True)), "word"), (starters, "next_word")):
        small = table.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        rows = rows.join(F.broadcast(table), key, "left") if small else lookup(rows, table, key, "left")
    held = (F.col("_short").isNotNull() | F.col("word").rlike(r"^\p{L}$")) & ~(F.coalesce(F.col("next_capital"), F.lit(False)) & F.col("_starter").isNotNull())
    held = held | F.col("word").rlike(r"^[0-9]+$") & ~F.coalesce(F.col("next_capital"), F.lit(False))
    ends = rows.where((F.col("mark") != ".") | ~held).groupBy(F.col(id_col).alias("_id")).agg(F.collect_list("pos").alias("_ends"))
    cut = documents.join(ends, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    cut = cut.withColumn("_ends", F.expr("array_sort(array_distinct(concat(coalesce(_ends, cast(array() as array<int>)), array(size(tokens) - 1))))"))
    begin = "IF(i = 0, 0, _ends[greatest(i, 1) - 1] + 1)"
    return cut.select(id_col, F.posexplode(F.expr(f"transform(_ends, (e, i) -> array_join(slice(tokens, {begin} + 1, e - {begin} + 1), ' '))")).alias("n", "sentence"))
