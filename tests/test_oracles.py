"""Every query that has SQL against that SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from spindrift import queries as library

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float)):
        return "None" if isinstance(x, float) and math.isnan(x) else repr(float(x))
    return str(x)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_matches(spark, duck, name):
    df = library.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(library.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in names) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_runs(spark, name):
    assert library.queries()[name](spark, FOLDER).count() > 0
