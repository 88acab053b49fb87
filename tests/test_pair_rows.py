"""A pair stays one row in the pair operators, whatever its reports hold; values against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from textflow.operators import linkage as K
from textflow.operators import senses as S
from textflow.session import cut_lineage

PAIRS = [(1, 2, 1), (2, 1, 0), (1, 2, 1), (1, 3, 0), (3, 4, 0), (4, 5, 0), (2, 9, 0), (5, 2, 1), (None, 2, 0)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "l long, r long, class int").coalesce(2)


def _senses():
    up = {"a.x": [("a.x", 0), ("x", 1), ("root", 2)], "b.x": [("b.x", 0), ("x", 1), ("root", 2)], "c.y": [("c.y", 0), ("y", 1), ("root", 2)], "lone": [("lone", 0)]}
    held = {1: ["a.x", "a.x", "c.y", "unknown"], 2: ["b.x", "lone", "c.y"], 3: ["lone"], 4: ["unknown"], 5: ["a.x", None]}
    return up, held


@pytest.mark.parametrize("which", ["best", "mean"])
def test_similarities_of_pairs(spark, which):
    up, held = _senses()
    depth = 3
    ancestors = spark.createDataFrame([(s, a, d) for s, rows in up.items() for a, d in rows] + [(None, "root", 0), ("a.x", None, 0), ("nulls", None, None)], "sense string, ancestor string, dist int")
    chosen = spark.createDataFrame([(i, s) for i, some in held.items() for s in some], "id long, sense string")

    def sim(a, b):
        least = min((x + y for p, x in up.get(a, []) for q, y in up.get(b, []) if p == q), default=None)
        return None if least is None else -math.log((least + 1) / (2 * depth))

    def value(l, r):
        a, b = ([s for s in held.get(k, []) if s] for k in (l, r))
        if not a or not b:
            return None
        if which == "mean":
            return sum(sim(x, y) or 0.0 for x in a for y in b) / (len(set(a)) * len(set(b)))
        most = [max(found) for x in set(a) if (found := [s for y in b if (s := sim(x, y)) is not None])]
        return sum(most) / len(most) if most else None

    out = getattr(S, f"pair_sense_{which}")(_pairs(spark), chosen, ancestors, depth)
    assert "Aggregate" not in _plan(out) and out.columns == ["l", "r", "class", f"sense_{which}"]
    got = {(r.l, r.r): r[3] for r in out.collect()}
    assert out.count() == len(PAIRS)
    assert got == pytest.approx({(l, r): value(l, r) for l, r, _ in PAIRS})


@pytest.mark.parametrize("weighted", [False, True])
def test_overlap_of_pairs(spark, weighted):
    held = {1: ["a", "a", "b", None], 2: ["a", "b", "c"], 3: ["c"], 4: [None], 5: ["a", "z"]}
    idf = {"a": 0.5, "b": 2.0, "c": 1.5}
    terms = spark.createDataFrame([(i, t) for i, some in held.items() for t in some], "id long, term string")
    table = spark.createDataFrame(list(idf.items()), "term string, idf double") if weighted else None

    def value(l, r):
        if l not in held or r not in held:
            return None
        both = sum(held[l].count(t) * held[r].count(t) * (idf.get(t, 0.0) if weighted else 1) for t in set(held[l]) & set(held[r]) - {None})
        return both / ((len(held[l]) + 1) * (len(held[r]) + 1))

    out = K.pair_overlap(_pairs(spark), terms, "id", idf=table)
    assert "Aggregate" not in _plan(out) and out.count() == len(PAIRS)
    assert {(r.l, r.r): r.overlap for r in out.collect()} == pytest.approx({(l, r): value(l, r) for l, r, _ in PAIRS})


def test_cosine_of_pairs(spark):
    held = {1: {1: 3.0, 2: 4.0}, 2: {2: 1.0, 5: 1.0}, 3: {}, 4: {5: 2.0}}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in held.items()}
    vectors = spark.createDataFrame([(i, v, norm[i]) for i, v in held.items()], "id long, terms map<bigint,double>, norm double")
    out = K.pair_cosine(_pairs(spark), vectors, "id", "cosine")
    assert "Aggregate" not in _plan(out) and out.count() == len(PAIRS)
    want = {(l, r): sum(x * held[r].get(k, 0) for k, x in held[l].items()) / norm[l] / norm[r] if l in held and r in held and norm[l] * norm[r] else None for l, r, _ in PAIRS}
    assert {(r.l, r.r): r.cosine for r in out.collect()} == pytest.approx(want)


def test_written_tables_are_compressed_and_not_cached(spark):
    out = cut_lineage(spark.range(200_000).select("id", F.lit("the same text in every row").alias("text")))
    assert out.count() == 200_000 and "FileScan parquet" in _plan(out.select("id")) and "InMemoryTableScan" not in _plan(out)
