import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.quantiles import quantiles
from tabloom.functions.stats import ColumnStats, fit_stats, modes

SHARES = [0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.9, 1]


def expected(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = share * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def shapes():
    rng = random.Random(5)
    yield "uniform", [rng.random() for _ in range(3000)]
    yield "one value holds a third", [7.0 if rng.random() < 0.34 else rng.gauss(0, 100) for _ in range(3000)]
    yield "two heavy values", [1.0] * 1500 + [2.0] * 1500
    yield "constant", [4.0] * 2000
    yield "with gaps", [None if i % 3 else float(i) for i in range(2000)]
    yield "skewed", [rng.random() ** 30 * 1e12 for _ in range(3000)]
    yield "negative and integer", [float(rng.randint(-5, 5)) for _ in range(3000)]
    yield "single", [3.5]
    yield "nothing", [None, None]


@pytest.mark.parametrize("name,values", list(shapes()))
def test_narrowing_is_exact(spark, name, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    for settings in ({}, {"map_values": 0, "span_rows": 10, "accuracy": 100},
                     {"map_values": 0, "span_rows": 200, "accuracy": 1000}):
        found = quantiles(df, {"x": SHARES}, **settings)["x"]
        for p in SHARES:
            assert found[p] == pytest.approx(expected(values, p)), (settings, p)


def test_neighbouring_ranks_share_spans(spark):
    shares = [0.5 + i / 10000 for i in range(-20, 20)]
    df = spark.range(5000).select((F.col("id") * 1.5).alias("x"), F.col("id").alias("y"))
    found = quantiles(df, {"x": shares, "y": shares}, map_values=0, span_rows=50, accuracy=200)
    for p in shares:
        assert found["x"][p] == pytest.approx(p * 4999 * 1.5)
        assert found["y"][p] == pytest.approx(p * 4999)


def test_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),)] * 300 + [(-float("inf"),)] * 300 + [(float(i),) for i in range(400)], "x double")
    found = quantiles(df, {"x": [0.1, 0.5, 0.9]}, map_values=0, span_rows=10, accuracy=100)["x"]
    assert found[0.1] == -float("inf") and found[0.9] == float("inf")
    assert found[0.5] == pytest.approx(199.5)


def test_stats_treat_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    s = fit_stats(df, {"x": [0.5]})["x"]
    assert (s.rows, s.known, s.distinct, s.mean, s.median, s.min, s.max) == (4, 2, 2, 2.0, 2.0, 1.0, 3.0)
    assert ColumnStats.from_dict(s.as_dict()) == s


def test_distinct_count_is_near(spark):
    for n in (1, 3, 10, 30):
        df = spark.range(5000).select((F.col("id") % n).alias("x"))
        assert fit_stats(df, {"x": []})["x"].distinct == n
    many = fit_stats(spark.range(100_000).select(F.col("id").alias("x")), {"x": []})["x"].distinct
    assert abs(many - 100_000) < 3_000
    assert fit_stats(spark.range(5).select(F.lit(None).cast("double").alias("x")), {"x": [0.5]})["x"].distinct == 0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "x string, y string")
    assert modes(df, ["x", "y"]) == {"x": "a", "y": None}
