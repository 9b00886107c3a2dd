"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from conftest import SF

from lexilake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(repr(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(db.sql(registry.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
