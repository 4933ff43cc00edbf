"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([round(r[k], 9) if isinstance(r[k], float) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cursor.fetchall(), names)


def test_entry(spark):
    assert sum(r.matches for r in entry.entry(spark).collect()) == 8931
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_digits_of_large_keys(spark, tmp_path):
    """Fourth powers beyond a long: from 55,109 on."""
    found = [0, 1, 9, 10, 56, 57, 177, 178, 316, 317, 55_108, 55_109, 90_000, 900_000, 10**10 - 1, 2**63 - 1, -(2**63), -3, -178, None]
    spark.createDataFrame(list(enumerate(found)), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.pk: r.n for r in queries.QUERIES["missing_digits"](spark, str(tmp_path)).collect()}
    assert got == {k: 0 if sk is None else 10 - min(10, len(str(sk**4))) for k, sk in enumerate(found)}
