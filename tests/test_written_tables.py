"""Tables that a round replaced are removed, and rows of rare words alone are shuffled."""

import os

import pytest

from textflow.operators import partitioned as P
from textflow.operators import vectors as V
from textflow.operators.features import tf_idf_terms
from textflow.session import checkpoint_dir

TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "rare words are here", "the end of the cat"]


def _tokens(spark):
    return spark.createDataFrame([(d, i, w) for d, t in enumerate(TEXTS) for i, w in enumerate(t.split())], "doc_id long, pos int, token string")


def _written(spark):
    top = checkpoint_dir(spark).removeprefix("file:").replace("//", "/")
    return {x for x in os.listdir(top) if x.startswith("cut-")}


def _kept(spark, make):
    before = _written(spark)
    rows = make().collect()
    return len(_written(spark) - before), rows


def test_replaced_vectors_are_removed(spark):
    few, one = _kept(spark, lambda: V.document_vectors(_tokens(spark), k=3, rounds=2)[0])
    many, two = _kept(spark, lambda: V.document_vectors(_tokens(spark), k=3, rounds=5)[0])
    assert few == many and len(one) == len(two)
    matrix = V.pmi(V.cooccurrences(_tokens(spark)), "word", "context")
    few, one = _kept(spark, lambda: V.subspace(matrix, "word", "context", "pmi", 2, rounds=1)[0])
    many, two = _kept(spark, lambda: V.subspace(matrix, "word", "context", "pmi", 2, rounds=4)[0])
    assert few == many and len(one) == len(two)


def test_frequent_words_are_sent(spark, monkeypatch):
    def rows():
        pmi = V.pmi(V.cooccurrences(_tokens(spark)), "word", "context")
        texts = spark.createDataFrame([(d, t.split()) for d, t in enumerate(TEXTS)], "doc_id long, t array<string>")
        both = pmi, tf_idf_terms(texts, "doc_id", "t").select("doc_id", "term", "tf", "tfidf")
        return [sorted(map(tuple, x.collect())) for x in both], [x._jdf.queryExecution().optimizedPlan().toString() for x in both]

    want, _ = rows()
    monkeypatch.setattr(P, "BROADCAST_KEYS", 8)
    got, plans = rows()
    assert all("LeftAnti" in p and "_salt" not in p for p in plans)
    for a, b in zip(got, want):
        assert [r[:2] for r in a] == [r[:2] for r in b] and [r[-1] for r in a] == pytest.approx([r[-1] for r in b])
