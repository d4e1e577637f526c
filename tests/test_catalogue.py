"""Every catalogue query against its SQL twin in DuckDB, and the entry points' shape."""

import math

import duckdb
import pytest

from plumbline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def rows(records):
    return sorted(tuple(plain(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_twin(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got.select(*names).collect()) == rows(want.project(", ".join(f'"{c}"' for c in names)).fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_twin_runs(spark, name):
    got = catalogue.queries()[name](spark, SF)
    assert got.columns and got.count() > 0


def test_entry_points(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 10
