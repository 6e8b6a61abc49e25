"""Every registered query that has SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexhaven.plans import catalog, oracle
from given_data import SMALL

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(SMALL + "/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cursor.fetchall())
    assert got == want and got


def test_flagship(spark):
    assert entry.entry(spark).count() == 5000


def test_all_have_sql():
    """The library's own queries all have SQL; those of the optional subpackage where SQL can express them."""
    assert set(catalog.queries()) == set(oracle.oracle_sql())
    assert set(ORACLE) <= set(QUERIES)
