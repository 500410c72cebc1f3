"""Repeatable samples and splits, decided by a hash of the row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import hash_text, hash_unit, named
from tabloom.operators.joins import attach
from tabloom.operators.profile import class_counts

SEED = 42
TASK_ROWS = 1_000, 500_000    # rows that are worth a task of their own, and rows a task should not exceed


def sample_rows(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` random rows (all when there are fewer): the smallest hashes of the row key.

    A counting pass thins the rows to somewhat more than ``n``; those are sorted in ranges, so no task holds them all.
    """
    rows = df.count()
    if rows <= n:
        return df
    margin = (n + 6 * n ** 0.5 + 20) / rows      # six deviations above the expected number
    return df.where(hash_unit(named(key), seed) < margin).orderBy(hash_text(named(key), seed), named(key)).limit(n)


def spread_rows(df: DataFrame, rows: int) -> DataFrame:
    """The rows dealt evenly over all cores, for work that reads them many times.

    Otherwise they stay in the few parts that a small file has, whatever the cores and the cost of a row. Rows are
    dealt in turn, not by key, so repeated and missing keys weigh nothing.
    """
    least, most = TASK_ROWS
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(min(cores, rows // least), -(-rows // most), 1))


def sample_share(df: DataFrame, share: float, key: str, seed: int = SEED) -> DataFrame:
    """About ``share`` of the rows, in one narrow pass."""
    return df.where(hash_unit(named(key), seed) < share)


def stratified_sample(df: DataFrame, n: int, label: str, key: str, seed: int = SEED) -> DataFrame:
    """About ``n`` rows with class shares kept and no class lost.

    Every class is thinned by the same share; the row of each class with the smallest hash stays whatever the share. A
    missing class counts as one.
    """
    rows = df.count()
    if rows <= n:
        return df
    hashed = hash_text(named(key), seed)
    first = df.groupBy(named(label)).agg(F.min(hashed).alias("__first"), F.count(F.lit(1)).alias("__rows"))
    joined = attach(df.withColumn("__h", hashed), first, label, "__rows")
    missing = df.where(named(label).isNull()).agg(F.min(hashed)).first()[0]
    least = F.coalesce(F.col("__first"), F.lit(missing))
    return joined.where((hash_unit(named(key), seed) < n / rows) | (F.col("__h") == least)).drop("__h", "__first")


def sampling_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """Class shares before and after sampling."""
    totals = [d.select(F.count(F.lit(1))).scalar() for d in (before, after)]
    left = class_counts(before, label).withColumnRenamed("n", "n_before")
    right = class_counts(after, label).withColumnRenamed("n", "n_after")
    joined = left.join(right, "label", "left").fillna(0, ["n_after"])
    return joined.withColumns({"share_before": F.col("n_before") / totals[0],
                               "share_after": F.col("n_after") / totals[1]})


def split(df: DataFrame, key: str, test_share: float = 0.2, label: str | None = None,
          seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows.

    The hash of the key decides, so class shares hold up to sampling error at any size. With
    ``label``, every class of at least two rows is present on both sides: its row with the largest
    hash trains and the one with the smallest tests, whatever the cut.
    """
    marked = marked_split(df, key, test_share, label, seed)
    return (marked.where(~F.col("__test")).drop("__test"),
            marked.where(F.col("__test")).drop("__test"))


def marked_split(df: DataFrame, key: str, test_share: float = 0.2, label: str | None = None,
                 seed: int = SEED) -> DataFrame:
    """The rows with a ``__test`` flag."""
    test = hash_unit(named(key), seed) < test_share
    if label is None:
        return df.withColumn("__test", test)
    # a training target holds few classes; the ends of each come back as one small row
    hashed = hash_text(named(key), seed)
    ends = (df.groupBy(named(label)).agg(F.min(hashed).alias("__first"), F.max(hashed).alias("__last"))
            .where("__first < __last"))
    joined = attach(df.withColumn("__h", hashed), ends, label)
    decided = (F.when(F.col("__h") == F.col("__first"), True)
               .when(F.col("__h") == F.col("__last"), False).otherwise(test))
    return joined.withColumn("__test", decided).drop("__h", "__first", "__last")
