"""Every query against its SQL on the smallest tables: columns, row count and values."""

import datetime
import decimal
import math

import duckdb
import pytest

from vestigraph.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    a, b = sorted_rows(df.columns, got), sorted_rows(names, rows)
    assert len(a) == len(b)
    assert a == b
