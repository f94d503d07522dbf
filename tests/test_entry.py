import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sedge import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["orderkey", "total"]
    df.collect()


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(map(str, r)) for r in want.fetchall()))
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == rows


@pytest.mark.parametrize("name", ["order_then", "order_desc_nulls", "distinct_projection"])
def test_whole_results_in_order(spark, db, name):
    """No row cap: all rows, in the order of the SQL."""
    got = catalogue.QUERIES[name](spark, DATA)
    want = db.execute(catalogue.SQL[name])
    assert [d[0] for d in want.description] == got.columns
    rows = want.fetchall()
    assert "LIMIT" not in catalogue.SQL[name] and [tuple(r) for r in got.collect()] == rows
    if name == "order_desc_nulls":
        assert rows[0][1] is not None and rows[-1][1] is None
