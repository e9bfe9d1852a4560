"""Every audit query against its SQL in another engine, on the smallest tables; those without SQL must run."""

import math
import os

import duckdb
import pytest

from repolith.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def other(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, int | float):
            return None if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
        return str(v)

    return [columns[i] for i in order], sorted(map(str, ([plain(r[i]) for i in order] for r in data)))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, other, name):
    mine = QUERIES[name](spark, sf)
    got = rows(mine.columns, mine.collect())
    if name in ORACLES:
        theirs = other.execute(ORACLES[name])
        assert got == rows([d[0] for d in theirs.description], theirs.fetchall())
