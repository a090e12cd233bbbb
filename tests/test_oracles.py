"""Every named query of the library gives the same values as its SQL twin. (The corpus operators have tests
of their own.)"""

import duckdb
import pytest

import __spark_entry__ as entry
from stopflow.checks.catalog import QUERIES

from .conftest import DATA


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def test_every_query_is_registered_with_its_twin():
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, db):
    df = QUERIES[name].dataframe(spark, DATA)
    theirs = db.sql(QUERIES[name].sql())
    assert sorted(df.columns) == sorted(theirs.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(theirs.columns, theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
