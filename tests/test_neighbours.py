"""Mutual information by nearest neighbours against a version that compares all pairs of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators.neighbours import digamma, neighbour_information


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def plain(rows, k):
    rows = [(x, y) for x, y in rows if x is not None and math.isfinite(x) and y is not None]
    sizes = {y: sum(c == y for _, c in rows) for _, y in rows}
    rows = [(x, y) for x, y in rows if sizes[y] > 1]
    if not rows:
        return None
    total = 0.0
    for i, (x, y) in enumerate(rows):
        near = min(k, sizes[y] - 1)
        radius = sorted(abs(x - o) for j, (o, c) in enumerate(rows) if c == y and j != i)[near - 1]
        within = sum(x - radius < o < x + radius if radius else o == x for o, _ in rows)
        if not radius:
            near = sum(o == x and c == y for o, c in rows)
        total += psi(near) - psi(sizes[y]) - psi(within)
    return max(0.0, psi(len(rows)) + total / len(rows))


def sample():
    rng = random.Random(12)
    rows = []
    for i in range(500):
        y = rng.choice(["a", "a", "a", "b", "c", None]) if i > 5 else ["few", "few", "one", "three", "three", "three"][i]
        shift = {"a": 0, "b": 3, "c": 1}.get(y, 0)
        rows.append((y, rng.gauss(shift, 1), rng.randint(0, 4) + shift, 7.0 if rng.random() < 0.4 else rng.random(),
                     rng.choice([None, float("nan"), float("inf"), 1.5, rng.random()]), 3.0, None))
    return rows


@pytest.mark.parametrize("k,parts", [(1, 1), (3, 7), (3, 64), (5, 16)])
def test_all_pairs(spark, k, parts):
    names = ["normal", "whole", "hot.value", "gaps", "same", "none"]
    rows = sample()
    df = spark.createDataFrame(rows, ", ".join(["y string", *[f"`{c}` double" if c != "whole" else "whole int" for c in names]]))
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.feature: r.mutual_info for r in neighbour_information(df, names, "y", k).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert set(found) == set(names)
    for i, c in enumerate(names, 1):
        wanted = plain([(r[i], r[0]) for r in rows], k)
        assert found[c] is None if wanted is None else found[c] == pytest.approx(wanted, abs=1e-9), c


def test_few_values_and_independence(spark):
    df = spark.range(4000).selectExpr("id % 2 AS y", "double(id % 2) AS same", "double(id % 4 >= 2) AS other", "double(hash(id)) AS noise")
    found = {r.feature: r.mutual_info for r in neighbour_information(df, ["same", "other", "noise"], "y").collect()}
    assert found["same"] == pytest.approx(math.log(2), abs=1e-3) and found["other"] < 1e-3 and found["noise"] < 0.05


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([("a", 1.0)], "y string, x double")
    for rows in (df, df.where("false")):
        assert [tuple(r) for r in neighbour_information(rows, ["x"], "y").collect()] == [("x", None)]
    with pytest.raises(ValueError):
        neighbour_information(df, ["x"], "y", 0)


def test_digamma(spark):
    values = [1, 2, 3, 10, 1000]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(digamma(F.col("v")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([psi(v) for v in values], abs=1e-11)
