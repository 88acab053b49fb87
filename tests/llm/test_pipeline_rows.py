"""The pipeline's stages decide by row: repeated and missing ids."""

from pyspark.sql import functions as F

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def test_classifier_stages_judge_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    free = docs.join(labels.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    more = docs.unionByName(free.withColumn("doc_id", F.lit(-7).cast("long"))).unionByName(free.withColumn("doc_id", F.lit(None).cast("long")))
    ids, own = {r.doc_id for r in free.collect()}, [r.text for r in free.collect()]
    for name in ("quality_classifier", "toxicity"):
        got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[name](spark, more, FOLDER).collect()]
        want = sorted(t for t in own if (-7, t) in set(got))
        assert 0 < len(want) < len(own)
        assert sorted(t for i, t in got if i in ids) == want == sorted(t for i, t in got if i == -7)
        assert sorted(t for i, t in got if i is None) == want


def test_near_duplicates_with_one_id(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(40))

    rows = [(7, text(k)) for k in range(30)] + [(7, text(3)), (9, text(4)), (None, text(50)), (None, text(50)), (None, text(51)), (None, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "row": F.lit(2), "n_chars": F.length("text")})
    out = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(got, key=str) == sorted([*[(7, text(k)) for k in range(30)], (None, text(50)), (None, text(51))], key=str)
