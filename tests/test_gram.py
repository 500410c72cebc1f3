"""Masked correlations against numpy, pair by pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import association as A
from tabloom.operators import gram


@pytest.mark.parametrize("block", [1000, 3])
@pytest.mark.parametrize("tasks", [3, 130])
def test_pairs(spark, block, tasks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6)) @ rng.normal(size=(6, 7)) + np.array([0, 1e9, -5, 0, 1e5, 0, 3])
    x[:, 5] = 4.25                                             # no variance
    gaps = rng.random(x.shape) < 0.2
    gaps[:, 3] |= np.arange(900) > 0                           # one row only
    rows = [[None if g else float(v) for v, g in zip(r, gap)] for r, gap in zip(x, gaps)]
    df = spark.createDataFrame(rows, ", ".join(f"c{k} double" for k in range(7))).repartition(tasks)
    found = gram.correlations(df, [F.col(c) for c in df.columns], block)
    for i in range(7):
        for j in range(7):
            both = ~gaps[:, i] & ~gaps[:, j]
            if both.sum() < 2 or 5 in (i, j):
                assert math.isnan(found[i, j]), (i, j)
            else:
                # a column around 1e9 has seven digits left
                assert found[i, j] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-6 if 1 in (i, j) else 1e-10)


def test_report(spark):
    df = spark.createDataFrame([(1, 2.0, None, 1.0), (2, 4.0, None, float("inf")), (3, 6.5, 1.0, 2.0), (None, 1.0, None, 0.0)],
                               "a int, b double, c double, d double")
    got = {(r.left, r.right): r.correlation for r in A.correlation_pairs(df, df.columns).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])
    assert got[("a", "c")] is None and got[("b", "c")] is None and math.isnan(got[("a", "d")]) and len(got) == 6
    assert A.correlation_pairs(df.where("false"), ["a", "b"]).collect()[0].correlation is None


def test_all_nulls_in_some_tasks(spark):
    x = np.arange(200.0)
    rows = [(float(v), None if v < 100 else float(v) ** 2) for v in x]
    df = spark.createDataFrame(rows, "a double, b double").coalesce(1)
    found = gram.correlations(df.repartitionByRange(8, "a"), [F.col("a"), F.col("b")])
    assert found[0, 1] == pytest.approx(np.corrcoef(x[100:], x[100:] ** 2)[0, 1], abs=1e-12)
