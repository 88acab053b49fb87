
from pyspark.sql import functions as F

from textflow.operators import linkage as K
from textflow.operators.partitioned import blocked_pairs, position_index
from textflow.plans import fixtures as FX
from textflow.plans.linkage import prepared_reports

SMALL = "/root/testdata/sf0.001"


def test_blocked_pairs_equal_plain_self_join(spark):
    rows = [(i, f"g{i % 3}") for i in range(40)] + [(100 + i, "hot") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {(r.l, r.r) for r in blocked_pairs(df, "g", "id", block=7).collect()}
    want = {(a, b) for a, ga in rows for b, gb in rows if ga == gb and a < b}
    assert got == want


def test_position_index_dense_and_partition_independent(spark):
    rows = [(i * 3 + 1, f"g{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string")
    for parts in (1, 7):
        x = position_index(df.repartition(parts), "id", by=["g"], name="p", max_cells=5)
        got = {(r.id, r.p) for r in x.collect()}
        want = set()
        for g in {g for _, g in rows}:
            ids = sorted(i for i, gg in rows if gg == g)
            want |= {(i, k) for k, i in enumerate(ids)}
        assert got == want
    glob = {r.id: r.p for r in position_index(df, "id", name="p", max_cells=3).collect()}
    assert sorted(glob.values()) == list(range(200)) and glob[1] == 0


def test_pair_properties(spark):
    rep = prepared_reports(FX.incidents(spark, SMALL))
    stats = K.link_stats(rep, "offender").first().asDict()
    pos = K.positive_pairs(rep)
    neg = K.negative_pairs(rep, stats=stats)
    assert pos.count() == stats["linked"]
    k = stats["to_select"]
    per = neg.groupBy("l").agg(F.count("*").alias("n")).select("n").distinct().collect()
    assert [r.n for r in per] == [k]
    grp = rep.select(F.col("incident_id").alias("id"), "offender")
    x = neg.join(grp.withColumnRenamed("id", "l").withColumnRenamed("offender", "gl"), "l") \
        .join(grp.withColumnRenamed("id", "r").withColumnRenamed("offender", "gr"), "r")
    assert x.where("gl = gr").count() == 0
    assert x.groupBy("l").agg(F.count_distinct("gr").alias("d")).where(f"d <> {k}").count() == 0


def test_too_few_groups_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "incident_id long, offender string")
    with pytest.raises(ValueError):
        K.negative_pairs(df, ratio=5)


def test_blank_narratives_kept_apart(spark):
    df = spark.createDataFrame(
        [(1, "A", "", "h0"), (2, "B", "", "h0"), (3, "B", "", "h0"), (4, "C", "x", "h1"), (5, "D", "x", "h1")],
        "incident_id long, offender string, narrative string, narrative_hash string")
    keep = {r.incident_id: r.offender for r in K.primary_offender(df).collect()}
    merge = {r.incident_id: r.offender for r in K.primary_offender(df, blank="merge").collect()}
    assert keep == {1: "A", 2: "B", 3: "B", 4: "C", 5: "C"}
    assert merge == {1: "B", 2: "B", 3: "B", 4: "C", 5: "C"}
