"""Pairs made in packed cells: the draws that SQL replays, whatever the blocks; columns of both reports travel with the pairs."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textflow.operators import draws as D
from textflow.operators import linkage as K
from textflow.operators import pair_cells as C
from textflow.operators.dots import shared_products
from textflow.session import cut_lineage, release

STATS = {"groups": 24, "to_select": 11}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows():
    rows = [(i * 7 + 3, f"g{i % 23}") for i in range(300)] + [(-5, "g1"), (10 ** 15, "g2"), (-10 ** 13, "g2"), (None, "g3"), (None, "g4"), (18, None)]
    return rows + [(100000 + i, "g7") for i in range(120)]


def _replayed(spark, rows, seed):
    """K3 by its definition, the draws by the SQL steps."""
    groups = {}
    for i, g in rows:
        groups.setdefault(g, []).append(i)
    ranked = {g: sorted(ids, key=lambda i: (i is not None, i)) for g, ids in groups.items()}  # without an id first, as they meet nothing
    order = sorted(groups, key=lambda g: min(i for i in groups[g] if i is not None))
    n, k = len(groups), STATS["to_select"]
    a, b, over = D.factors(n - 1)
    ids = [i for i, g in rows if i is not None and g is not None]
    h = [((x % D.M) + (int(x / D.M) % D.M) * 40503) % D.M for x in (i + seed for i in ids)]
    keyed = D.with_steps(spark.createDataFrame(list(zip(ids, h)), "l long, h long"), D.key_steps("h"))
    drawn = D.with_steps(keyed.selectExpr("*", f"explode(sequence(0L, {k - 1}L)) AS j"), D.draw_steps("j", f"{n - 1}L", f"{a}L", f"{b}L", over + 1))
    y, pick = D.mixed("j", "_k1")
    drawn = drawn.localCheckpoint()
    own, out = {i: order.index(g) for i, g in rows if i is not None}, []
    for r in D.with_steps(drawn.select("l", "j", "_draw", "_k1"), [("y", y), ("p", pick.format(y="y"))]).collect():
        g = order[(own[r.l] + 1 + r._draw) % n]
        target = ranked[g][r.p % len(ranked[g])] if g is not None else None
        if target is not None:
            out.append((r.l, target))
    return Counter(out)


@pytest.mark.parametrize("block", [16, 64, 1 << 20])
def test_cells_replay_the_draws(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "CELL", 512)
    monkeypatch.setattr(C, "AT_ONCE", 300)
    rows = _rows()
    df = spark.createDataFrame(rows, "incident_id long, offender string").repartition(5)
    out = K.negative_pairs(df, seed=3, stats=STATS)
    assert "SortMergeJoin" not in _plan(out) and "Generate" not in _plan(out)  # no draw is a shuffled row
    assert Counter((r.l, r.r) for r in out.collect()) == _replayed(spark, rows, 3)


def test_pairs_carry_columns_of_both_reports(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 128)
    rows = [r for r in _rows() if r[0] is not None]
    df = spark.createDataFrame(rows, "incident_id long, offender string").repartition(3)
    side = spark.createDataFrame([(i, [i, 1], {1: float(i)}) for i, _ in rows if i % 2], "incident_id long, many array<long>, held map<int,double>")
    made = K.LabelledPairs(df.where("offender is not null"), stats={"groups": 23, "to_select": 11})
    plain, out = made.frame(), made.with_sides(side, side.drop("held"))
    assert out.columns == ["l", "r", "weight", "class", "l_many", "l_held", "r_many"]
    assert sorted(map(tuple, out.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    for r in out.collect():
        assert r.l_many == ([r.l, 1] if r.l % 2 else None) and r.r_many == ([r.r, 1] if r.r % 2 else None)
        assert r.l_held == ({1: float(r.l)} if r.l % 2 else None)


def test_a_report_given_twice_meets_each_of_its_rows(spark):
    notes = [(i, f"g{i % 6}", f"house {i % 5} locked gate", i) for i in range(40)] + [(3, "g3", "window bolted", 99)]
    reports = spark.createDataFrame(notes, "incident_id long, offender string, method_of_entry string, hour int")
    from textflow.plans.linkage import method_vectors
    vectors, specs = method_vectors(reports), [("hour", "hour", ["hour"])]
    made = K.LabelledPairs(reports, stats={"groups": 6, "to_select": 2})
    lazy = K.pair_table(made, reports, vectors, ["a", "b"], specs=specs)
    joined = K.pair_table(cut_lineage(made.frame()), reports, vectors, ["a", "b"], specs=specs)
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in joined.dtypes]
    assert Counter(map(tuple, lazy.select(rounded).collect())) == Counter(map(tuple, joined.select(rounded).collect()))


def test_products_of_maps(spark):
    import pyarrow as pa
    rng = np.random.default_rng(1)
    for kind, keys in ((pa.int32(), range(-5, 30)), (pa.int64(), [int(x) for x in rng.integers(-2 ** 62, 2 ** 62, 30)])):
        maps = [[None if rng.random() < 0.1 else {k: float(rng.integers(1, 9)) for k in rng.permutation(keys)[:rng.integers(0, 12)]} for _ in range(200)] for _ in range(2)]
        arrays = [pa.array([m and list(m.items()) if m is None or m else [] for m in some], pa.map_(kind, pa.float64())) for some in maps]
        want = [None if a is None or b is None else sum(v * b.get(k, 0) for k, v in a.items()) for a, b in zip(*maps)]
        assert shared_products(*arrays).to_pylist() == want
        assert shared_products(*(x.slice(40, 100) for x in arrays)).to_pylist() == want[40:140]


def test_shuffle_files_go_with_the_written_table(spark, tmp_path):
    import os
    top = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def held():
        return {f for d in top for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_") and f.endswith(".data")}

    before = held()
    out = cut_lineage(spark.range(10_000).repartition(5, "id"))
    assert not held() - before and out.count() == 10_000
    file = out.inputFiles()[0].removeprefix("file:").replace("//", "/")
    assert os.path.exists(file)
    release(out)
    assert not os.path.exists(file)
