"""a term of a document stays one row; F2: pairs of words are counted once for both ways round."""

import pytest

from textflow.operators.features import doc_embedding
from textflow.operators.vectors import cooccurrences


def test_weighted_means_without_a_row_per_number(spark):
    vectors = {"a": [1.0, 2.0, 4.0], "b": [0.0, -1.0, 3.0]}
    weights = [(1, "a", 2.0), (1, "b", 1.0), (2, "b", 0.5), (3, "c", 1.0), (None, "a", 1.0)]
    out = doc_embedding(None, spark.createDataFrame(list(vectors.items()), "word string, vector array<double>"), spark.createDataFrame(weights, "doc_id long, term string, tfidf double"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.embedding for r in out.collect()}
    assert set(got) == {1, 2, None}
    assert got[1] == pytest.approx([2 / 3, 1.0, 11 / 3]) and got[2] == pytest.approx(vectors["b"]) and got[None] == pytest.approx(vectors["a"])


def test_pairs_of_words_are_shuffled_once(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate(["a", "b", "a", "a"])], "doc_id long, pos int, token string")
    out = cooccurrences(tokens, window=2)
    assert {(r.word, r.context): r.n for r in out.collect()} == {("a", "a"): 4, ("a", "b"): 3, ("b", "a"): 3}
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
