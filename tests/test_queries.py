"""Every registered query of the sequence operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from seqloom import queries as base

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
UNIQUE = list({id(f): n for n, f in reversed(base.QUERIES.items())}.values())[::-1]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(df):
    def plain(v):
        if isinstance(v, (np.ndarray, list)):
            return str([plain(x) for x in v])
        if isinstance(v, (float, np.floating)):
            return "null" if np.isnan(v) else repr(round(float(v), 6))
        return str(v)

    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


def test_every_query_has_sql():
    assert set(base.SQL) == set(base.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", UNIQUE)
def test_query(spark, con, name):
    assert rows(base.QUERIES[name](spark, DIR).toPandas()) == rows(con.sql(base.SQL[name]).df())
