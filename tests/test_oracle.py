"""Every query of the library's own that SQL can express, against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from recframe import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return x + 0.0
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    if name not in queries.ORACLE_SQL:
        assert got.count() > 0
        return
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == want


def test_category_counts_lose_no_event(spark):
    data = DATA.replace("sf0.001", "sf0.1")  # ids beyond the 200 of category_counts_dense
    got = queries.QUERIES["category_counts_all"](spark, data).collect()
    assert sum(r["freq"] for r in got) == spark.read.parquet(f"{data}/events.parquet").count()
    assert sorted(r["id"] for r in got) == list(range(len(got)))
