"""The operators that SQL can express, against that SQL in another engine."""

import os

import duckdb
import pytest

from repolith.llm import registry


@pytest.mark.parametrize("name", registry.oracle_sql())
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    theirs = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    mine = registry.queries()[name](spark, folder)
    assert sorted(mine.columns) == sorted(columns)
    got, want = sorted(map(tuple, mine.select(*columns).collect())), sorted(theirs.fetchall())
    assert got == want and len(got) > 100
