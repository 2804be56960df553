"""Every registered query against its SQL on the smallest given tables."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check import bag  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, db, name):
    out = queries()[name](spark, SF)
    rows = out.collect()
    if name in oracle_sql():
        rel = db.execute(oracle_sql()[name])
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(out.columns)
        assert bag(rows, out.columns) == bag(rel.fetchall(), cols)


def test_entry(spark):
    assert entry(spark).count() > 0
