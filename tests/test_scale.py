"""Hot keys, odd id ranges and narrow input types."""

import pytest
from pyspark.sql import functions as F

from textflow.functions.distance import grid_distance
from textflow.operators.features import count_vector_terms
from textflow.operators.linkage import attach_count, finish_features, negative_pairs, primary_offender
from textflow.operators.partitioned import cells, lookup, position_index
from textflow.operators.relational import split_by_key


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle, and no adaptive splitting: what salting alone does."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def _hot(spark, n=12_000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 500).alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("size", [None, "n"])
def test_lookup_spreads_a_hot_key(shuffled, how, size):
    rows = _hot(shuffled)
    per_key = rows.where("key < 400").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = lookup(rows, per_key, "key", how, size=size)
    assert sorted(out.columns) == ["id", "key", "n"]
    assert sorted(map(str, out.collect())) == sorted(map(str, rows.join(per_key, "key", how).select(out.columns).collect()))
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 0.4 * rows.count()  # 8 tasks; unsalted, one has two thirds


def test_attach_count_spreads_a_hot_key(shuffled):
    out = attach_count(_hot(shuffled), "key")
    assert out.where("key = 0").select("n").distinct().collect()[0].n == out.where("key = 0").count()
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 4800


def test_blank_reports_are_spread(shuffled):
    reports = shuffled.range(4000).select("id", F.lit("h0").alias("narrative_hash"), F.lit("").alias("narrative"),
                                          (F.col("id") % 50).cast("string").alias("offender"))
    out = primary_offender(reports)
    assert out.where("offender <> cast(id % 50 as string)").count() == 0
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2400


@pytest.mark.parametrize("ids", ["id + if(id = 0, 1000000000000000, 0)", "id + 5000000000", "id * id * id", "-id"])
def test_positions_do_not_depend_on_the_spread_of_ids(spark, ids):
    df = spark.range(5000).select(F.expr(f"cast({ids} as bigint)").alias("x"))
    got = [r._pos for r in position_index(df, "x", max_cells=64).orderBy("x").collect()]
    assert got == list(range(5000))
    assert cells(df, "x", 64).groupBy("_cell").count().agg(F.max("count")).first()[0] <= 500


def test_int_input(spark):
    rows = [(i, f"g{i % 80}", 5_400_000 + i, 1_700_000 - i) for i in range(400)]
    df = spark.createDataFrame(rows, "incident_id int, offender string, northing int, easting int")
    wide = df.withColumn("incident_id", F.col("incident_id").cast("long"))
    assert sorted(negative_pairs(df).collect()) == sorted(negative_pairs(wide).collect())
    pair = spark.createDataFrame([(5_429_000, 1_744_000, 5_600_000, 1_900_000)], "a int, b int, c int, d int")
    assert pair.select(grid_distance("a", "b", "c", "d")).first()[0] == 231467
    assert split_by_key(df, "incident_id").count() == 400


def test_every_term_is_kept(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "id long, t array<string>")
    assert sorted(map(tuple, count_vector_terms(df, "id", "t").collect())) == [(1, "a", 2.0), (1, "b", 1.0), (2, "c", 1.0)]
    assert sorted(map(tuple, count_vector_terms(df, "id", "t", vocab_size=1).collect())) == [(1, "a", 2.0)]
    assert sorted(map(tuple, count_vector_terms(df, "id", "t", min_df=1, binary=True).collect())) == [(1, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)]


def test_a_feature_without_values_is_named(spark):
    df = spark.createDataFrame([(1, 2, None, 1.0, 1)], "l long, r long, hour int, weight double, class int")
    with pytest.raises(ValueError, match="hour"):
        finish_features(df)
