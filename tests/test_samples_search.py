"""R10 samples by key and M8 searches from sums."""

import numpy as np
import pytest

from textflow.operators import sampling as S
from textflow.operators.search import ridge_search


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_samples_are_the_same_on_any_partitioning(spark):
    df = spark.range(4000).selectExpr("id", "id % 7 AS v")
    for draw in (lambda d: S.sample_by_key(d, "id", 0.3), lambda d: S.sample_with_replacement(d, "id", 1.5), lambda d: S.sample_exactly(d, "id", 777)):
        one = _rows(draw(df.repartition(1)))
        assert one == _rows(draw(df.repartition(9, "v")))
    assert abs(len(_rows(S.sample_by_key(df, "id", 0.3))) - 1200) < 150
    assert _rows(S.sample_by_key(df, "id", 0.3, seed=2)) != _rows(S.sample_by_key(df, "id", 0.3))


def test_poisson_counts(spark):
    df = spark.range(20000)
    for mean in (0.0, 0.2, 1.0, 4.0):
        counts = {r.id: r["count"] for r in S.sample_with_replacement(df, "id", mean).groupBy("id").count().collect()}
        times = np.array([counts.get(i, 0) for i in range(20000)])
        assert abs(times.mean() - mean) < 0.06 and abs(times.var() - mean) < 0.2
    assert S.poisson_bounds(0.0) == []


@pytest.mark.parametrize("n", [0, 1, 399, 400, 401, 5000])
def test_exact_sizes(spark, n):
    df = spark.createDataFrame([(i, "x") for i in range(399)] + [(None, "y")], "id long, v string")
    got = S.sample_exactly(df, "id", n)
    assert got.columns == ["id", "v"] and got.count() == min(n, 400)
    assert S.sample_exactly(df.limit(0), "id", n).count() == 0


def test_search_equals_refitting(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=500)
    fold = rng.integers(0, 4, 500)
    rows = [(*map(float, a), float(b), int(f)) for a, b, f in zip(x, y, fold)] + [(None, 1.0, 1.0, 1.0, 0), (1.0, float("nan"), 1.0, 1.0, 1), (1.0, 1.0, 1.0, 9.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int")
    table, best, model = ridge_search(df, ["a", "b", "c"], "y", [0.0, 0.1, 10.0], "fold")
    errors = {}
    for r in table.collect():
        train, test = fold != r.fold, fold == r.fold
        mean, my = x[train].mean(0), y[train].mean()
        a = (x[train] - mean).T @ (x[train] - mean) / train.sum() + r.penalty * np.eye(3)
        beta = np.linalg.solve(a, (x[train] - mean).T @ (y[train] - my) / train.sum())
        assert r.coefficients == pytest.approx(beta) and r.intercept == pytest.approx(my - mean @ beta)
        errors.setdefault(r.penalty, []).append(((y[test] - r.intercept - x[test] @ beta) ** 2).mean())
        assert r.mse == pytest.approx(errors[r.penalty][-1])
    assert best == min(errors, key=lambda p: np.mean(errors[p])) and len(model) == 4
    with pytest.raises(ValueError):
        ridge_search(df.where("fold = 1"), ["a"], "y", [1.0], "fold")
