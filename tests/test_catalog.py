"""Each query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from noteforge import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    if name in catalog.SQL:
        want = duck.sql(catalog.SQL[name])
        columns = ",".join(f'"{c}"' for c in sorted(want.columns))
        assert got == sorted(tuple(plain(x) for x in r) for r in want.project(columns).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
