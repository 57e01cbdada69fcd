"""Registered queries against their SQL on a driver table."""

import duckdb
import pytest

from evidrake.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=repr)
    want = sorted(c.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want and len(got) > 100
