"""Every query against its SQL on the small tables."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(v[i]) for i in order) for v in values)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, DATA)
    want = sql.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


def test_moving_average(spark):
    values = {}
    for user, _, v in duckdb.sql(f"SELECT user_id, event_id, value FROM '{DATA}/events.parquet' ORDER BY event_id").fetchall():
        values[user] = (values.get(user, 0) * 9 + int(v)) // 10
    assert {r["user_id"]: r["average"] for r in catalogue.ema(spark, DATA).collect()} == values


def test_hash_to_unit(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h / 2**32

    names = dict(duckdb.sql(f"SELECT c_custkey, c_name FROM '{DATA}/customer.parquet'").fetchall())
    assert {r[0]: r[1] for r in catalogue.hash_to_unit(spark, DATA).collect()} == {k: fnv(v) for k, v in names.items()}
