"""Every registered query with SQL gives the same rows as that SQL does."""

import datetime
import decimal
import os

import duckdb
import pytest

from auralake.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events documents embeddings labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in ORACLE:
        want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE[name]})").fetchall()
        assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
