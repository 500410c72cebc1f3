"""Correlation, chi-square and mutual information as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.bins import bin_sql
from tabloom.functions.scalars import named, number
from tabloom.functions.stats import fit_stats
from tabloom.operators.gram import correlation_report
from tabloom.operators.profile import to_rows

MISSING = "(missing)"


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute correlation of every pair of columns over the rows where both are known.

    One scan for up to a thousand columns; see ``gram``.
    """
    return correlation_report(df, [number(c) for c in columns], columns)


def target_correlation(df: DataFrame, columns: Sequence[str], target: str | Column) -> DataFrame:
    """Correlation of every column with a numeric target."""
    y = number(target)
    row = df.agg(*[F.corr(number(c), y).alias(f"r{i}") for i, c in enumerate(columns)])
    return to_rows(row, columns, {"correlation": "r{i}"})


def greedy_correlated_drop(pairs: DataFrame, with_target: dict[str, float],
                           threshold: float = 0.85) -> list[tuple[str, str, float]]:
    """Columns to drop among correlated pairs, strongest pair first.

    Of a pair the column with the weaker link to the target goes; on a tie the second one.
    The pair list is as large as the square of the column count at most.
    """
    strong = (pairs.where(F.col("correlation") >= threshold)
              .orderBy(F.desc("correlation"), "left", "right").collect())
    gone: dict[str, tuple[str, float]] = {}
    for left, right, r in strong:
        if left in gone or right in gone:
            continue
        keep_left = abs(with_target.get(left) or 0) >= abs(with_target.get(right) or 0)
        drop, keep = (right, left) if keep_left else (left, right)
        gone[drop] = (keep, r)
    return [(drop, keep, r) for drop, (keep, r) in gone.items()]


DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday}


def part_columns(moment: str) -> dict[str, Column]:
    return {f"{moment}_{name}": part(named(moment)) for name, part in DATE_PARTS.items()}


def part_crosstab(df: DataFrame, moment: str, label: str) -> DataFrame:
    """Rows per date part value and class, for the four parts at once."""
    parts = part_columns(moment)
    tall = df.select(named(label).alias("label"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("part"), p.alias("value")) for n, p in parts.items()])).alias("e"))
    return (tall.select("e.part", "e.value", "label").where("value IS NOT NULL AND label IS NOT NULL")
            .groupBy("part", "value", "label").agg(F.count(F.lit(1)).alias("n")))


def chi_square(crosstab: DataFrame, group: str = "part", x: str = "value", y: str = "label",
               corrected: bool = False) -> DataFrame:
    """Chi-square statistic and degrees of freedom per group of cell counts.

    Written as ``N * (sum(n^2 / (row * column)) - 1)``, which needs the filled cells only.
    ``corrected`` applies the continuity correction to two-by-two tables.
    """
    rows = crosstab.groupBy(group, x).agg(F.sum("n").cast("double").alias("row_n"))
    columns = crosstab.groupBy(group, y).agg(F.sum("n").cast("double").alias("column_n"))
    cells = crosstab.join(rows, [group, x]).join(columns, [group, y])
    n = F.sum("n").cast("double")
    share = F.sum(F.col("n") * F.col("n") / (F.col("row_n") * F.col("column_n")))
    summed = cells.groupBy(group).agg(n.alias("n"), (n * (share - 1)).alias("chi2"))
    shape = (rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows_"), F.product("row_n").alias("row_p"))
             .join(columns.groupBy(group).agg(F.count(F.lit(1)).alias("columns_"),
                                              F.product("column_n").alias("column_p")), group))
    dof = (F.col("rows_") - 1) * (F.col("columns_") - 1)
    product = F.col("row_p") * F.col("column_p")
    apart = F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) * product / F.col("n")) - F.col("n") / 2
    yates = F.col("n") * F.pow(F.greatest(apart, F.lit(0.0)), F.lit(2.0)) / product
    value = F.when(dof == 1, yates).otherwise(F.col("chi2")) if corrected else F.col("chi2")
    return summed.join(shape, group).select(group, value.alias("chi2"), dof.alias("dof"))


def chi_square_tail(value: float, dof: int) -> float:
    """Probability of a larger chi-square value: a finite sum for whole degrees of freedom."""
    if dof <= 0 or value <= 0:
        return 1.0
    x = value / 2
    start, total = (0.5, math.erfc(math.sqrt(x))) if dof % 2 else (0.0, 0.0)
    steps = dof // 2
    for i in range(steps):
        k = start + i
        total += math.exp(k * math.log(x) - x - math.lgamma(k + 1)) if x > 0 else 0.0
    return min(1.0, total)


def temporal_chi_square(df: DataFrame, moment: str, label: str, corrected: bool = False) -> DataFrame:
    return chi_square(part_crosstab(df, moment, label), corrected=corrected)


def temporal_p_values(df: DataFrame, moment: str, label: str) -> dict[str, float]:
    """P-value of independence between each date part and a class label."""
    return {r["part"]: chi_square_tail(r["chi2"], r["dof"])
            for r in temporal_chi_square(df, moment, label, corrected=True).collect()}


def temporal_correlation(df: DataFrame, moment: str, target: str) -> DataFrame:
    parts = part_columns(moment)
    slim = df.select(named(target), *[p.cast("double").alias(n) for n, p in parts.items()])
    return target_correlation(slim, list(parts), target)


def coded(df: DataFrame, columns: Sequence[str], numeric: Sequence[str], bins: int = 20) -> DataFrame:
    """Text codes ``x0, x1, ...`` of the columns: the value, or the quantile bin of a number with many values."""
    shares = [i / bins for i in range(bins + 1)]
    stats = fit_stats(df, {c: shares for c in columns if c in numeric})
    held = df.select(*[(number(c) if c in numeric else named(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    codes = []
    for i, c in enumerate(columns):
        code = f"v{i}"
        if c in numeric and stats[c].distinct > bins:
            code = bin_sql(code, sorted({e for e in stats[c].edges(*shares) if e is not None}))
        codes.append(F.expr(f"coalesce(CAST({code} AS STRING), '{MISSING}')").alias(f"x{i}"))
    return held.select(*codes)


def mutual_information(df: DataFrame, columns: Sequence[str], target: str,
                       numeric: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """Plug-in mutual information (in nats) of each column with the target.

    Numbers are cut at quantiles first. Cell counts come from one grouped aggregate; the entropies
    need only sums of ``n ln n``, so nothing is joined back to rows.
    """
    names = list(columns)
    codes = coded(df.where(named(target).isNotNull()), [*names, target], numeric, bins)
    codes = codes.withColumnRenamed(f"x{len(names)}", "y")
    tall = codes.select("y", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(len(names))]))
                        .alias("at", "x"))
    listed = F.array(*[F.lit(c) for c in names])
    cells = (tall.groupBy("at", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
             .withColumn("feature", listed[F.col("at")]))

    def weighted_log(grouped: DataFrame, out: str) -> DataFrame:
        return grouped.groupBy("feature").agg(F.sum(F.col("n") * F.ln("n")).alias(out),
                                              F.sum("n").alias(f"{out}_n"))

    joint = weighted_log(cells, "joint")
    left = weighted_log(cells.groupBy("feature", "x").agg(F.sum("n").alias("n")), "left")
    right = weighted_log(cells.groupBy("feature", "y").agg(F.sum("n").alias("n")), "right")
    n = F.col("joint_n")
    value = F.ln(n) + (F.col("joint") - F.col("left") - F.col("right")) / n
    return (joint.join(left, "feature").join(right, "feature")
            .select("feature", F.greatest(value, F.lit(0.0)).alias("mutual_info")))


def normalized(scores: DataFrame, column: str = "mutual_info", out: str = "normalized") -> DataFrame:
    """Scores divided by the largest one; a feature-sized table."""
    top = scores.select(F.max(column)).scalar()
    return scores.withColumn(out, F.when(top > 0, F.col(column) / top).otherwise(F.lit(0.0)))
