import os
import tempfile

from pyspark.sql import functions as F

from textflow.plans import fixtures as FX
from textflow.plans.incidents import incident_features

SMALL = "/root/testdata/sf0.001"


def test_arff_export(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
    from textflow.sources.files import write_arff
    schema = StructType([StructField("feature_vec", VectorUDT()), StructField("weight", DoubleType()),
                         StructField("class", IntegerType())])
    df = spark.createDataFrame([(Vectors.dense([0.5, 1.0]), 1.0, 1), (Vectors.dense([0.0, 0.25]), 0.5, 0)],
                               schema)
    out = write_arff(df, tempfile.mkdtemp(prefix="arff-"), ["a", "b", "weight", "class"])
    header = spark.read.text(os.path.join(out, "header"), wholetext=True).first()[0]
    assert header.startswith("@RELATION reports") and "@ATTRIBUTE class {0,1}" in header
    lines = sorted(r.value for r in spark.read.text(os.path.join(out, "data")).collect())
    assert lines == ["0.0,0.25,0.5,0", "0.5,1.0,1.0,1"]


def test_model_save_load(spark):
    from pyspark.ml import Pipeline, PipelineModel
    from textflow.operators.stages import IncidentFeatures, NormalizingTokenizer
    pipe = Pipeline(stages=[IncidentFeatures(), NormalizingTokenizer(inputCol="method_of_entry", outputCol="t")])
    inc = FX.incidents(spark, SMALL)
    model = pipe.fit(inc)
    path = os.path.join(tempfile.mkdtemp(prefix="model-"), "m")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    a = model.transform(inc).select("incident_id", "t").orderBy("incident_id").collect()
    b = again.transform(inc).select("incident_id", "t").orderBy("incident_id").collect()
    assert a == b


def test_streaming_equals_batch(spark):
    from textflow.streaming import stream_incident_features, stream_reports, write_stream
    src = tempfile.mkdtemp(prefix="stream-src-")
    inc = FX.incidents(spark, SMALL)
    inc.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "in"))
    s = stream_reports(spark, os.path.join(src, "in"), inc.schema)
    out = os.path.join(src, "out")
    q = write_stream(stream_incident_features(s).drop("moe_tokens"), out, "test-" + os.path.basename(src))
    q.awaitTermination(120)
    got = spark.read.parquet(out).orderBy("incident_id").collect()
    want = incident_features(inc).orderBy("incident_id").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
