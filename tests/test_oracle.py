"""Every registered query with an oracle equals its DuckDB SQL (at sf0.001)."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import digest

SMALL = "/root/testdata/sf0.001"
ORACLE = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_sql(spark, duck, name):
    sdf = E.queries()[name](spark, SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_a_docstring_and_runs_schema():
    for name, fn in E.queries().items():
        assert fn.__doc__, name


ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_query_runs(spark, name):
    df = E.queries()[name](spark, SMALL)
    assert df.count() >= 0 and df.columns


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"l", "r", "weight", "class"} <= set(df.columns)
