"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def rows(table, columns):
    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(round(value, 8) + 0.0)
        return str(value)

    at = [table[0].index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in at) for r in table[1])


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, db, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    relation = db.execute(catalog.SQL[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    expected = relation.fetchall()
    assert rows((found.columns, [tuple(r) for r in found.collect()]), columns) == rows((names, expected), columns)


def test_every_query_has_rows(spark):
    for name in set(catalog.QUERIES) - set(catalog.SQL):
        assert catalog.QUERIES[name](spark, str(DATA)).count() > 0
