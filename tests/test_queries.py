"""Every registered query against its SQL, run by DuckDB over the same tables."""

import duckdb
import pytest

from loamdex.plans.catalogue import FLAGSHIP, ORACLES, QUERIES
from loamdex.sources.files import TABLES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return "" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in found.collect())
    if name not in ORACLES:
        assert rows
        return
    wanted = duck.sql(ORACLES[name])
    assert sorted(wanted.columns) == columns
    at = [wanted.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in wanted.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(ORACLES) <= set(QUERIES)
