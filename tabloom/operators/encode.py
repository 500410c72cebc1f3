"""Imputing, scaling, encoding and selecting columns.

All fitted values are one row of statistics or one table keyed by category. Tables are attached
with a size-checked join; nothing the size of the data passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.bins import interval_sql, sql_double
from tabloom.functions.scalars import distinct_sketch, named, number, numeric_columns, quoted, text_columns
from tabloom.functions.stats import fit_stats, modes
from tabloom.operators.association import mutual_information
from tabloom.operators.joins import attach
from tabloom.operators.profile import to_rows
from tabloom.session import checkpoint

WIDEST = 5_000              # one-hot columns that one category may give


def impute_numbers(df: DataFrame, columns: Sequence[str], strategy: str = "median") -> DataFrame:
    """Missing numbers replaced by the median or the mean of the column."""
    stats = fit_stats(df, {c: [0.5] if strategy == "median" else [] for c in columns})
    typical = {c: s.median if strategy == "median" else s.mean for c, s in stats.items()}
    return df.withColumns({c: F.coalesce(number(c), F.lit(v)) for c, v in typical.items()})


def impute_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing categories replaced by the most frequent one, the smallest on ties."""
    typical = {c: v for c, v in modes(df, columns).items() if v is not None}
    return df.withColumns({c: F.coalesce(named(c), F.lit(v)) for c, v in typical.items()})


def scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centred and divided by the population deviation; a constant column becomes zero."""
    stats = fit_stats(df, {c: [] for c in columns})
    return df.withColumns({c: (number(c) - F.lit(s.mean)) / F.lit(s.std_pop or 1.0)
                           for c, s in stats.items()})


def frequent_values(df: DataFrame, column: str, limit: int | None) -> tuple[list, bool]:
    """Values to encode in sorted order, and whether rarer ones share one extra column.

    Over ``limit`` values the ``limit - 1`` most frequent stay. Without a limit all values stay, and
    a column too wide for that is refused.
    """
    counts = (df.where(named(column).isNotNull()).groupBy(named(column).alias("v"))
              .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")))
    if limit is None:
        values = [r["v"] for r in counts.select("v").limit(WIDEST + 1).collect()]
        if len(values) > WIDEST:
            raise ValueError(f"{column} has over {WIDEST} values; one_hot_sparse has no such limit")
        return sorted(values), False
    rows = counts.limit(limit + 1).collect()
    if len(rows) <= limit:
        return sorted(r["v"] for r in rows), False
    return sorted(r["v"] for r in rows[:limit - 1]), True


def one_hot_columns(column: str, values: Sequence, other: bool = False,
                    prefix: str | None = None) -> dict[str, Column]:
    """A 0/1 column per value; NULL and unknown values are all zeros."""
    prefix = column if prefix is None else prefix
    made = {f"{prefix}_{v}": F.coalesce((named(column) == F.lit(v)).cast("int"), F.lit(0))
            for v in values}
    if other:
        rare = named(column).isNotNull() & ~named(column).isin(list(values))
        made[f"{prefix}_infrequent"] = F.coalesce(rare.cast("int"), F.lit(0))
    return made


def one_hot(df: DataFrame, columns: Sequence[str], max_categories: int | None = 10) -> DataFrame:
    """One-hot columns in place of each category column, at most ``max_categories`` per column."""
    made: dict[str, Column] = {}
    for c in columns:
        values, other = frequent_values(df, c, max_categories)
        made |= one_hot_columns(c, values, other)
    return df.withColumns(made).drop(*columns)


def one_hot_sparse(df: DataFrame, column: str, out: str = "one_hot") -> DataFrame:
    """One sparse vector with a slot per value in sorted order, whatever their number; none is set for NULL.

    Values are numbered by a table that is attached by key, so no dictionary passes through the driver; the fitted encoder
    would, as it names every slot in the schema.
    """
    table = category_index(df, column)
    width = max(table.count(), 1)

    @F.udf(returnType=VectorUDT())
    def one_slot(slot):
        return Vectors.sparse(width, [slot], [1.0]) if slot >= 0 else Vectors.sparse(width, [], [])

    return ordinal(df, column, table, "__slot").withColumn(out, one_slot("__slot")).drop("__slot")


def dummies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Plain dummies for all values, none for NULL."""
    return one_hot(df, columns if columns is not None else text_columns(df), None)


def numbered(values: DataFrame, column: str, out: str = "index") -> DataFrame:
    """Rows of distinct values with their position in sorted order.

    They are range-sorted and written; every partition then starts at the total of the partitions before it.
    """
    placed = checkpoint(values.orderBy(named(column)).withColumn("__at", F.monotonically_increasing_id()))
    part, at = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    start, starts = 0, []
    for p in sorted(sizes):
        starts += [F.lit(p).cast("bigint"), F.lit(start).cast("bigint")]
        start += sizes[p]
    return placed.withColumn(out, F.element_at(F.create_map(*starts), part) + at).drop("__at")


def category_index(df: DataFrame, column: str) -> DataFrame:
    """Table ``(column, __rows, index)`` of the sorted known values."""
    counts = (df.where(named(column).isNotNull()).groupBy(named(column))
              .agg(F.count(F.lit(1)).alias("__rows")))
    return numbered(counts, column)


def ordinal(df: DataFrame, column: str, fitted: DataFrame | None = None,
            out: str | None = None) -> DataFrame:
    """Position of the value among the sorted values; -1 for NULL or a value unseen in the fit."""
    out = out or f"{column}_index"
    table = (fitted if fitted is not None else category_index(df, column))
    table = table.withColumnRenamed("index", out)
    joined = attach(df, table, column, "__rows" if "__rows" in table.columns else None)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("bigint")))


def label_encode(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Class numbers from 0 in sorted order; a missing class counts as the class ``None``."""
    filled = df
    if target in text_columns(df):
        filled = df.withColumn(target, F.coalesce(named(target), F.lit("None")))
    return ordinal(filled, target, out=out)


def target_table(df: DataFrame, column: str, target: str | Column, smoothing: float = 1.0) -> DataFrame:
    """Smoothed target mean per category: ``(sum + s * prior) / (n + s)``."""
    y = number(target)
    slim = df.where(named(column).isNotNull()).select(named(column), y.alias("__y"))
    prior = df.select(F.avg(y)).scalar()
    n, total = F.count("__y"), F.coalesce(F.sum("__y"), F.lit(0.0))
    return slim.groupBy(named(column)).agg(
        ((total + F.lit(smoothing) * prior) / (n + F.lit(smoothing))).alias("__encoded"),
        F.count(F.lit(1)).alias("__rows"))


def target_encode(df: DataFrame, column: str, target: str | Column, smoothing: float = 1.0,
                  out: str | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Category replaced by its smoothed target mean; unknown ones get the overall mean."""
    out = out or f"{column}_target"
    table = fitted if fitted is not None else target_table(df, column, target, smoothing)
    joined = attach(df, table.withColumnRenamed("__encoded", out), column, "__rows")
    prior = df.select(F.avg(number(target))).scalar()
    return joined.withColumn(out, F.coalesce(F.col(out), prior))


def binary_columns(index: Column, values: int, prefix: str) -> dict[str, Column]:
    """Bits of the one-based index, highest first; unknown values are all zeros."""
    bits = max(1, math.ceil(math.log2(values + 1)))
    code = F.when(index >= 0, index + 1).otherwise(F.lit(0)).cast("bigint")
    return {f"{prefix}_{bits - 1 - b}": (code.bitwiseAND(F.lit(1 << b)) != 0).cast("int")
            for b in reversed(range(bits))}


def binary_encode(df: DataFrame, column: str) -> DataFrame:
    """The ordinal position written in as few 0/1 columns as it needs."""
    table = category_index(df, column)
    values = table.count()
    coded = ordinal(df, column, table, "__index")
    return coded.withColumns(binary_columns(F.col("__index"), values, column)).drop("__index")


def hash_encode(df: DataFrame, columns: Sequence[str], width: int | None = None,
                out: str = "hashed") -> DataFrame:
    """Categories hashed into one sparse vector; needs no dictionary, whatever the cardinality."""
    width = width or min(50, 3 * len(columns))
    return FeatureHasher(inputCols=list(columns), outputCol=out, numFeatures=width,
                         categoricalCols=list(columns)).transform(df)


# fixed values: a published rational approximation of normal quantiles, relative error under 1.15e-9
NORMAL_MIDDLE = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
                 -3.066479806614716e+01, 2.506628277459239e+00)
NORMAL_MIDDLE_UNDER = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
                       -1.328068155288572e+01, 1.0)
NORMAL_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
               4.374664141464968e+00, 2.938163982698783e+00)
NORMAL_TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
NORMAL_BORDER = 0.02425


def _polynomial(x: Column, factors: Sequence[float]) -> Column:
    value = F.lit(factors[0])
    for f in factors[1:]:
        value = value * x + F.lit(f)
    return value


def with_inverse_normal(df: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Normal quantiles of share columns (``output -> share column``), exact to about nine digits.

    Laid out in steps so that each step is evaluated once per row.
    """
    steps, signed = {}, {}
    for out, p in shares.items():
        share, q = named(p), named(f"__q_{out}")
        steps[f"__q_{out}"] = F.when(F.least(share, 1.0 - share) >= NORMAL_BORDER, share - 0.5).otherwise(
            F.sqrt(F.lit(-2.0) * F.ln(F.least(share, F.lit(1.0) - share))))
        middle = _polynomial(q * q, NORMAL_MIDDLE) * q / _polynomial(q * q, NORMAL_MIDDLE_UNDER)
        tail = _polynomial(q, NORMAL_TAIL) / _polynomial(q, NORMAL_TAIL_UNDER)
        signed[out] = F.when(F.least(share, 1.0 - share) >= NORMAL_BORDER, middle).when(share < 0.5, tail).otherwise(-tail)
    return df.withColumns(steps).withColumns(signed).drop(*steps)


SMALLEST_SHARE = 1e-7


def share_sql(value: str, edges: Sequence[float]) -> str:
    """SQL for the share of reference values at or under a column, linear between its quantiles.

    Repeated quantiles form a step whose middle is taken.
    """
    last = len(edges) - 1
    knots: list[tuple[float, float]] = []
    start = 0
    for i in range(1, len(edges) + 1):
        if i == len(edges) or edges[i] != edges[start]:
            knots.append((edges[start], (start + i - 1) / 2 / last))
            start = i
    if len(knots) == 1:
        return f"if({value} IS NULL, NULL, 0.5D)"
    ramps = [sql_double(knots[0][1])]
    for (x0, p0), (x1, p1) in zip(knots, knots[1:]):
        ramps.append(f"{sql_double(p0)} + ({value} - {sql_double(x0)}) * {sql_double((p1 - p0) / (x1 - x0))}")
    ramps.append(sql_double(knots[-1][1]))
    return f"if({value} IS NULL, NULL, {interval_sql(value, [x for x, _ in knots], ramps)})"


def quantile_normal(df: DataFrame, columns: Sequence[str], points: int = 100) -> DataFrame:
    """Columns mapped onto a normal distribution through up to ``points`` quantiles."""
    stats = fit_stats(df, {c: [] for c in columns})
    rows = next(iter(stats.values())).rows if stats else 0
    points = max(2, min(points, rows))
    shares = [i / (points - 1) for i in range(points)]
    fitted = fit_stats(df, {c: shares for c in columns})
    df = df.withColumns({f"__p_{c}": number(c) for c in columns})
    df = df.withColumns({f"__p_{c}": F.expr(share_sql(quoted(f"__p_{c}"), fitted[c].edges(*shares)))
                         for c in columns})
    low, high = F.lit(SMALLEST_SHARE), F.lit(1 - SMALLEST_SHARE)
    df = df.withColumns({f"__p_{c}": F.when(named(f"__p_{c}").isNotNull(), F.greatest(
        F.least(named(f"__p_{c}"), high), low)) for c in columns})
    return with_inverse_normal(df, {c: f"__p_{c}" for c in columns}).drop(*[f"__p_{c}" for c in columns])


def split_by_cardinality(df: DataFrame, columns: Sequence[str], max_categories: int,
                         max_dummies: int = 1000) -> tuple[list[str], list[str], dict[str, int]]:
    """Category columns to one-hot encode and those with too many values.

    The widest columns move over until the one-hot columns fit the budget.
    """
    if not columns:
        return [], [], {}
    counted = df.agg(*[distinct_sketch(named(c)).alias(f"n{i}")
                       for i, c in enumerate(columns)]).first()
    sizes = {c: counted[f"n{i}"] for i, c in enumerate(columns)}
    low = [c for c in columns if sizes[c] <= max_categories]
    high = [c for c in columns if c not in low]
    for c in sorted(low, key=lambda c: -sizes[c]):
        if sum(sizes[x] for x in low) <= max_dummies:
            break
        low.remove(c)
        high.append(c)
    return low, high, sizes


def choose_encoding(target_classes: int | None, high: Sequence[str]) -> str:
    """Hashing for a class target with more than ten classes, else the target mean."""
    return "hashing" if high and target_classes is not None and target_classes > 10 else "target"


def varying_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Numeric columns whose variance is not zero."""
    columns = list(columns or numeric_columns(df))
    found = df.agg(*[F.var_pop(number(c)).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if found[f"v{i}"]]


def best_by_mutual_info(df: DataFrame, columns: Sequence[str], target: str, k: int,
                        bins: int = 20) -> DataFrame:
    """The ``k`` columns that share most information with a class target."""
    scored = mutual_information(df, columns, target,
                                [c for c in columns if c in numeric_columns(df)], bins)
    return scored.orderBy(F.desc("mutual_info"), "feature").limit(k)


def f_scores(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """F statistic of a linear fit of the target on each column alone."""
    y = number(target)
    row = df.agg(*[m for i, c in enumerate(columns) for m in (
        F.corr(number(c), y).alias(f"r{i}"),
        F.count_if(number(c).isNotNull() & y.isNotNull()).alias(f"n{i}"))])
    r2 = F.col("r") * F.col("r")
    f = F.when(r2 < 1, r2 / F.when(r2 < 1, F.lit(1.0) - r2) * (F.col("n") - 2)).when(r2 >= 1, F.lit(float("inf")))
    return to_rows(row, columns, {"r": "r{i}", "n": "n{i}"}).select("feature", f.alias("f"))


def best_by_f(df: DataFrame, columns: Sequence[str], target: str, k: int) -> DataFrame:
    return f_scores(df, columns, target).orderBy(F.desc_nulls_last("f"), "feature").limit(k)
