"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from glyphloom.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return f"{value + 0.0:.6f}"
    return "" if value is None else str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert types == {f.name: TYPES[f.dataType.simpleString()] for f in df.schema}
    assert table(rows, df.columns) == table(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 8


def test_every_sql_has_a_query():
    from glyphloom.plans.oracles import SQL
    assert set(SQL) <= set(entry.queries())
