"""Every library query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from lectern.plans import queries

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "documents pages labels benchmark embeddings events conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    found = sorted(repr(tuple(plain(row[c]) for c in columns)) for row in frame.collect())
    wanted = duck.sql(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(plain(row[i]) for i in places)) for row in wanted.fetchall())
