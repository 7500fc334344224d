"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

from glyphloom.llm.oracles import SQL
from glyphloom.llm.queries import QUERIES


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(cursor.fetchall(), key=key)


def test_every_operator_has_a_query():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and set(SQL) <= set(QUERIES)
