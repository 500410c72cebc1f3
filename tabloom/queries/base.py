"""Registration of queries and small helpers to write their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its SQL where there is one."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        name = run.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is there already")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Named columns rounded, so that both engines print the same digits."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


def cut_sql(value: str, edges: Sequence[str | float | None], labels: Sequence[str],
            lowest: bool = False) -> str:
    """CASE over right-closed bins; a None edge is open."""
    low = edges[0]
    inside = f"{value} IS NOT NULL" if low is None else f"{value} {'>=' if lowest else '>'} {low}"
    arms = []
    for upper, label in zip(edges[1:], labels):
        test = inside if upper is None else f"{inside} AND {value} <= {upper}"
        arms.append(f"WHEN {test} THEN '{label}'")
    return f"CASE {' '.join(arms)} END"


def flag_sql(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"
