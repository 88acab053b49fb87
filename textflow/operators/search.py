"""M8 in one pass: k-fold search of ridge regression from sufficient statistics.

What a linear model needs of a fold are its row count, the sums of features
and label, and the sums of their products.  One aggregation gives them for
every fold; the statistics without a fold are the whole's less the fold's, so
every (fold, penalty) is a small linear system on the driver, however many
rows there are, and the error on the fold is a form in the same sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_statistics(df: DataFrame, features: list[str], label: str, fold: str) -> dict[int, np.ndarray]:
    """Per fold the matrix of sums of products of (1, features, label).  Rows
    with a null or NaN in any of them, or without a fold, are left out."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(label).cast("double")]
    d = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]
    known = df.where(F.col(fold).isNotNull())
    for c in [*features, label]:
        known = known.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    out = {}
    for r in known.groupBy(F.col(fold).alias("_fold")).agg(*sums).collect():  # one row a fold
        s = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                s[i, j] = s[j, i] = r[f"s{i}_{j}"]
        out[r._fold] = s
    return out


def solve_ridge(s: np.ndarray, penalty: float) -> np.ndarray:
    """(intercept, coefficients) that minimise the mean squared error plus
    ``penalty`` times the squared coefficients; the intercept is free."""
    n = s[0, 0]
    mean, y = s[0, 1:-1] / n, s[0, -1] / n
    a = s[1:-1, 1:-1] / n - np.outer(mean, mean) + penalty * np.eye(len(mean))
    beta = np.linalg.lstsq(a, s[1:-1, -1] / n - mean * y, rcond=None)[0]
    return np.append(y - mean @ beta, beta)


def squared_error(s: np.ndarray, model: np.ndarray) -> float:
    """Mean squared error of a model on the rows behind the sums."""
    w = np.append(model, -1.0)
    return float(w @ s @ w / s[0, 0])


def ridge_search(df: DataFrame, features: list[str], label: str, penalties: list[float], fold: str) -> tuple[DataFrame, float, np.ndarray]:
    """(table, best penalty, its model on all rows).  The table has a row for
    every fold and penalty: fold, penalty, intercept, coefficients, mse on the
    fold of the model learned from the other folds.  The best penalty has the
    least mean of mse over folds; of equal ones the largest.  Needs two folds
    with rows."""
    folds = fold_statistics(df, features, label, fold)
    if len(folds) < 2:
        raise ValueError("a search needs rows in two folds at least")
    whole = sum(folds.values())
    rows = []
    for f in sorted(folds):
        for p in penalties:
            model = solve_ridge(whole - folds[f], p)
            rows.append((int(f), float(p), float(model[0]), [float(x) for x in model[1:]], squared_error(folds[f], model)))
    mean = {p: np.mean([r[4] for r in rows if r[1] == p]) for p in map(float, penalties)}
    best = min(mean, key=lambda p: (mean[p], -p))
    table = df.sparkSession.createDataFrame(rows, "fold int, penalty double, intercept double, coefficients array<double>, mse double")
    return table, best, solve_ridge(whole, best)
