import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from textflow.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    import tempfile

    import duckdb
    from textflow.plans.fixtures import TABLES
    con = duckdb.connect()
    con.execute(f"SET temp_directory='{tempfile.mkdtemp(prefix='duck-')}'")
    con.execute("SET memory_limit='4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con
