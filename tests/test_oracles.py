"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from trajspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr) == want
    assert want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
