"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from soilspark.plans.catalog import Tables, everything

FOLDER = os.environ.get("SOILSPARK_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = everything()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    if isinstance(v, (datetime, date)):
        return v.isoformat()[:19]
    return str(v) if not hasattr(v, "as_tuple") else f"{float(v):.9g}"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name].run(Tables(spark, FOLDER))
    want = duck.execute(QUERIES[name].sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    expected = rows(names, want.fetchall())
    assert expected
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name].run(Tables(spark, FOLDER)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
