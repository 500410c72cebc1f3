"""Column profiles, counts and class distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import distinct_sketch, named, numeric_columns, text_columns
from tabloom.functions.stats import fit_stats
from tabloom.operators.joins import attach


def to_rows(row: DataFrame, columns: Sequence[str], fields: dict[str, str],
            label: str = "feature") -> DataFrame:
    """One aggregate row as one row per column; ``fields`` maps output names to name patterns."""
    entries = [F.struct(F.lit(c).alias(label), *[
        named(pattern.format(i=i)).alias(out) for out, pattern in fields.items()])
        for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None,
                    exact: bool = True) -> DataFrame:
    """Per column: rows, nulls, distinct counts with and without NULL, ratios and screening flags.

    Each column is counted per value on its own, which reads every column once and shuffles only
    its distinct values; with ``exact=False`` a sketch answers in one scan without a shuffle.
    """
    columns = list(columns or df.columns)
    if exact:
        tall = None
        for c in columns:
            values = df.select(named(c).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
            part = values.agg(F.sum("n").alias("rows"), F.count("v").alias("distinct"),
                              F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
            part = part.select(F.lit(c).alias("feature"), "rows", "distinct", "nulls")
            tall = part if tall is None else tall.unionByName(part)
    else:
        measures = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(columns):
            measures += [distinct_sketch(named(c)).alias(f"distinct{i}"),
                         F.count_if(named(c).isNull()).alias(f"nulls{i}")]
        tall = to_rows(df.agg(*measures), columns,
                       {"rows": "rows", "distinct": "distinct{i}", "nulls": "nulls{i}"})
    rows = F.col("rows").cast("double")
    unique, missing = F.col("distinct") / rows, F.col("nulls") / rows
    kinds = set(text_columns(df))
    textual = F.col("feature").isin([c for c in columns if c in kinds])
    return (tall.withColumn("distinct_with_null",
                            F.col("distinct") + (F.col("nulls") > 0).cast("bigint"))
            .withColumns({"unique_ratio": unique, "null_ratio": missing})
            .withColumns({"constant": F.col("distinct_with_null") <= 1,
                          "id_like": F.col("unique_ratio") > 0.9,
                          "high_cardinality": textual & (F.col("unique_ratio") > 0.9),
                          "null_heavy": F.col("null_ratio") > 0.5}))


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that have missing values, with their number."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(named(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    return to_rows(counted, columns, {"missing": "n{i}"}).where("missing > 0")


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, deviation, range, quartiles and the stored bin edges of numeric columns."""
    columns = list(columns or numeric_columns(df))
    stats = fit_stats(df, {c: [0.25, 0.33, 0.5, 0.67, 0.75] for c in columns})
    rows = [(c, s.mean, s.std, s.min, s.max, *s.edges(0.25, 0.33, 0.5, 0.67, 0.75),
             *([s.mean + k * s.std for k in (-1, -0.5, 0.5, 1)] if s.std is not None else [None] * 4))
            for c, s in stats.items()]
    names = ["mean", "std", "min", "max", "q25", "q33", "median", "q67", "q75",
             "minus_sigma", "minus_half_sigma", "plus_half_sigma", "plus_sigma"]
    schema = "feature string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)


def value_counts(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """Most frequent values; ties by value so that the answer is the same every time."""
    counted = df.groupBy(named(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counted.orderBy(F.desc("n"), F.asc("value"))
    return ordered.limit(top) if top else ordered


def category_counts(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, dict[str, int]]:
    """Value counts of the columns that have at most ``most`` distinct values."""
    if not columns:
        return {}
    guess = df.agg(*[distinct_sketch(named(c)).alias(c) for c in columns]).first()
    small = [c for c in columns if guess[c] <= 2 * most + 10]
    found = {}
    for c in small:
        rows = (df.where(named(c).isNotNull()).groupBy(named(c).alias("v"))
                .agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect())
        if len(rows) <= most:
            found[c] = {str(r["v"]): r["n"] for r in rows}
    return found


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(named(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class; the total is a scalar subquery over the grouped rows."""
    counts = class_counts(df, label)
    total = counts.select(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def imbalance(df: DataFrame, label: str, threshold: float = 0.25) -> DataFrame:
    """Smallest over largest class, and whether that counts as imbalanced."""
    ratio = F.min("n") / F.max("n")
    return class_counts(df.where(named(label).isNotNull()), label).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
        ratio.alias("ratio"), (ratio < threshold).alias("imbalanced"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: rows over classes times class rows."""
    counts = class_counts(df.where(named(label).isNotNull()), label)
    total = counts.select(F.sum("n")).scalar()
    classes = counts.select(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total / (classes * F.col("n")))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    table = class_weights(df, label).select(
        F.col("label").alias(label), F.col("weight").alias(out), F.col("n").alias("__rows"))
    return attach(df, table, label, "__rows")


def dummy_total(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns that a full one-hot encoding would make."""
    columns = list(columns or text_columns(df))
    counted = df.agg(*[F.count_distinct(named(c)).alias(f"n{i}") for i, c in enumerate(columns)])
    return counted.select(sum((F.col(f"n{i}") for i in range(len(columns))), F.lit(0)).alias("dummies"))


def feature_families(names: Sequence[str], df: DataFrame) -> DataFrame:
    """How many generated columns each family has, by the ending of the name."""
    endings = ["_std_category", "_nps_category", "_recency_category", "_category", "_tier",
               "_price_strategy", "_stock_level", "_satisfaction", "_trend", "_zscore",
               "_is_outlier", "_is_high", "_above_median", "_recency_days", "_is_weekend",
               "_year", "_month", "_quarter"]
    rows = [(next((e[1:] for e in endings if n.endswith(e)), "ratio" if "_per_" in n else "other"),)
            for n in names]
    listed = df.sparkSession.createDataFrame(rows, "family string")
    return listed.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def candidate_targets(df: DataFrame, columns: Sequence[str], smallest: int = 5) -> DataFrame:
    """Generated class columns fit as targets: two classes or more, none under ``smallest`` rows."""
    tall = df.unpivot([], [named(c).cast("string").alias(c) for c in columns], "target", "class")
    counts = (tall.where("class IS NOT NULL").groupBy("target", "class")
              .agg(F.count(F.lit(1)).alias("n")))
    return (counts.groupBy("target").agg(F.count(F.lit(1)).alias("classes"),
                                         F.min("n").alias("smallest_class"))
            .where((F.col("classes") >= 2) & (F.col("smallest_class") >= smallest))
            .withColumn("task", F.when(F.col("classes") == 2, "binary").otherwise("multiclass")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several tables in one report."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, t in tables.items()]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def describe(df: DataFrame) -> dict[str, object]:
    """Shape and types of a table plus the number of missing values per column."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(named(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    return {"rows": counted["rows"], "columns": len(df.columns),
            "types": {f.name: f.dataType.simpleString() for f in df.schema},
            "missing": {c: counted[f"m{i}"] for i, c in enumerate(df.columns) if counted[f"m{i}"]},
            "head": df.limit(5)}
