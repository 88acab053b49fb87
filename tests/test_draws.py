"""K3's draws: permutations, their replay in SQL, and their independence."""

from collections import Counter

import pytest

from textflow.operators import draws as D
from textflow.operators import linkage as K


def _table(spark, n, reports, k):
    a, b, over = D.factors(n)
    keyed = D.with_steps(spark.range(reports).selectExpr("id AS l", "(id * 48271 + 11) % 2147483647 AS h"), D.key_steps("h"))
    drawn = D.with_steps(keyed.selectExpr("*", f"explode(sequence(0L, {k - 1}L)) AS j"), D.draw_steps("j", f"{n}L", f"{a}L", f"{b}L", over + 1))
    return drawn.select("l", "j", "_draw")


@pytest.mark.parametrize("n", [1, 2, 3, 7, 13, 97, 149, 1009])
def test_every_report_draws_a_permutation(spark, n):
    a, b, over = D.factors(n)
    assert a * b - over == n and 0 <= over < a
    rows = _table(spark, n, 5, n).collect()
    for i in range(5):
        assert sorted(r._draw for r in rows if r.l == i) == list(range(n))


def test_draws_of_two_reports_are_independent(spark):
    n, reports, k = 60, 6000, 6
    rows = _table(spark, n, reports, k).collect()
    hits = Counter(r._draw for r in rows)
    want = reports * k / n
    assert sum((hits[i] - want) ** 2 / want for i in range(n)) < 110  # chi-square, 59 degrees of freedom: 99.99 % below 109
    by = {}
    for r in rows:
        by.setdefault(r.l, [None] * k)[r.j] = r._draw
    for other in (1, 2, 7):  # differences of neighbours' draws, and pairs of one report's
        gaps = Counter((by[i][0] - by[i + other][0]) % n for i in range(reports - other))
        want = (reports - other) / n
        assert sum((gaps[i] - want) ** 2 / want for i in range(n)) < 110
    pairs = Counter((d[0] - d[1]) % n for d in by.values())
    want = reports / (n - 1)
    assert pairs[0] == 0 and sum((pairs[i] - want) ** 2 / want for i in range(1, n)) < 109


def test_negative_pairs_replay_on_any_partitioning(spark):
    rows = [(i * 7 + 3, f"g{i % 23}") for i in range(400)] + [(-5, "g1"), (10 ** 15, "g2")]
    df = spark.createDataFrame(rows, "incident_id long, offender string")
    stats = {"groups": 23, "to_select": 9}
    one, two = ({tuple(r) for r in K.negative_pairs(df.repartition(p), stats=stats).collect()} for p in (1, 6))
    assert one == two and len(one) == 9 * len(rows)
    group = dict(rows)
    assert all(group[left] != group[right] for left, right, _, _ in one)
    assert len({(left, group[right]) for left, right, _, _ in one}) == len(one)
    assert {tuple(r) for r in K.negative_pairs(df, stats=stats, seed=1).collect()} != one
