"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SQL = entry_points.oracle_sql()
QUICK = ["hash_encode", "score_clusters"]


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows):
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    df = entry_points.queries()[name](spark, folder)
    columns = sorted(df.columns)
    found = ordered(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = ordered(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert found == expected
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", QUICK)
def test_runs(spark, folder, name):
    assert entry_points.queries()[name](spark, folder).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 4
