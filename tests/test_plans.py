
import contextlib
import io

import __spark_entry__ as E

SMALL = "/root/testdata/sf0.001"


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_extractors_have_no_python_udf(spark):
    for name in ("incident_features", "pair_features", "normalize_tokens", "stolen_terms"):
        text = plan_text(E.queries()[name](spark, SMALL))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_scans_are_pruned(spark):
    text = plan_text(E.queries()["incident_features"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderdate:timestamp_ntz,o_orderpriority:string>" in text
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in text


def test_stems_use_arrow_batches(spark):
    text = plan_text(E.queries()["stems"](spark, SMALL))
    assert "ArrowEvalPython" in text and "BatchEvalPython" not in text
