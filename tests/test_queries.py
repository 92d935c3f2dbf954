"""Every stream query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from wavelath import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    rel = db.sql(queries.ORACLES[name])
    assert cols == sorted(rel.columns)
    mine = sorted(tuple(r) for r in got.select(*cols).collect())
    theirs = sorted(rel.select(*(f'"{c}"' for c in cols)).fetchall())
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, abs=2e-4)


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 500 * 32
