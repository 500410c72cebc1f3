"""Mutual information of numbers with a class by distances to the nearest neighbours, without cutting numbers into bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.scalars import named, number
from tabloom.operators.joins import attach
from tabloom.session import written

NEIGHBOURS = 3


def digamma(x: Column) -> Column:
    """Digamma of whole numbers from 1: six steps up, then the asymptotic series; the error is under 1e-11."""
    z = x.cast("double") + 6
    below = sum((1 / (x.cast("double") + i) for i in range(1, 6)), 1 / x.cast("double"))
    q = 1 / (z * z)
    return F.ln(z) - 1 / (2 * z) - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - below


def _ranged(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in ranges of the keys, their numbers in ``bucket``; stored, because the bounds come from a sample.

    There are as many as shuffle partitions; with a number given, small ones are not put together into one slow task.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(ranges, *keys).withColumn("bucket", F.spark_partition_id()), "ranges")


def _radii(cells: DataFrame, neighbours: int) -> DataFrame:
    """``radius`` of every cell: the distance to the k-th nearest other row of its class.

    A cell's neighbours are among the ``neighbours`` cells of its class on each side. Every range of values gets a halo of as
    many cells from the ranges before and after it; only the outermost cells of the ranges travel for that.
    """
    part = ["at", "y", "bucket"]
    inside = Window.partitionBy(*part).orderBy("x")
    cell = F.struct("x", "n")
    near = cells.select("*", F.row_number().over(inside).alias("place"),
                        F.collect_list(cell).over(inside.rowsBetween(-neighbours, -1)).alias("before"),
                        F.collect_list(cell).over(inside.rowsBetween(1, neighbours)).alias("after"),
                        F.count(F.lit(1)).over(Window.partitionBy(*part)).alias("cells"))
    first, last = F.col("place") <= neighbours, F.col("place") > F.col("cells") - neighbours
    ends = near.where(first | last).groupBy(*part).agg(
        F.sort_array(F.collect_list(F.when(first, cell))).alias("firsts"),
        F.sort_array(F.collect_list(F.when(last, cell))).alias("lasts"))
    along = Window.partitionBy("at", "y").orderBy("bucket")
    halo = ends.select(*part, F.flatten(F.collect_list("lasts").over(along.rowsBetween(-neighbours, -1))).alias("halo_before"),
                       F.flatten(F.collect_list("firsts").over(along.rowsBetween(1, neighbours))).alias("halo_after"))
    near = near.join(halo, part).withColumns({
        "before": F.slice(F.reverse(F.concat("halo_before", "before")), 1, neighbours),
        "after": F.slice(F.concat("after", "halo_after"), 1, neighbours)})
    near = near.withColumn("near", F.transform(F.concat("before", "after"), lambda c: F.struct(
        F.abs(c["x"] - F.col("x")).alias("d"), c["n"].alias("n"))))
    wanted = F.col("k") - (F.col("n") - 1)                       # equal rows of the class are neighbours at distance 0
    enough = F.filter("near", lambda c: F.aggregate(
        F.filter("near", lambda o: o["d"] <= c["d"]), F.lit(0).cast("bigint"), lambda total, o: total + o["n"]) >= wanted)
    radius = F.when(wanted <= 0, F.lit(0.0)).otherwise(F.array_min(F.transform(enough, lambda c: c["d"])))
    return near.select("at", "y", "x", "n", "k", "size", radius.alias("radius"))


def _counts_within(cells: DataFrame) -> DataFrame:
    """``within`` of every cell: how many rows of all classes lie nearer than its radius; equal ones where it is 0.

    Values and ends of intervals are put in one order; running sums are taken range by range on top of the sums of the
    ranges before, so no task sees a whole column.
    """
    alone = F.col("radius") == 0
    points = cells.groupBy("at", F.col("x").alias("v")).agg(F.sum("n").alias("w")).select(
        "at", "v", F.lit(1).alias("turn"), "w", F.lit(None).cast("string").alias("y"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("sign"))
    # an end that comes before the points of its own value counts the smaller ones, after them also the equal ones
    ends = cells.select("at", "y", "x", F.explode(F.array(
        F.struct((F.col("x") - F.col("radius")).alias("v"), F.when(alone, 0).otherwise(2).alias("turn"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + F.col("radius")).alias("v"), F.when(alone, 2).otherwise(0).alias("turn"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("at", "e.v", "e.turn", F.lit(0).cast("bigint").alias("w"), "y", "x", "e.sign")
    events = _ranged(points.unionByName(ends), "at", "v")
    lower = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = events.groupBy("at", "bucket").agg(F.sum("w").alias("w")).select(
        "at", "bucket", F.coalesce(F.sum("w").over(lower), F.lit(0)).alias("base"))
    inside = Window.partitionBy("at", "bucket").orderBy("v", "turn").rowsBetween(Window.unboundedPreceding, 0)
    running = events.withColumn("running", F.sum("w").over(inside)).where("sign <> 0").join(base, ["at", "bucket"])
    return running.groupBy("at", "y", "x").agg(F.sum(F.col("sign") * (F.col("base") + F.col("running"))).alias("within"))


def neighbour_information(df: DataFrame, columns: Sequence[str], target: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``feature`` and ``mutual_info`` (nats, at least 0) of numeric columns with a class, by nearest neighbours.

    For every row the distance to its k-th nearest row of the same class is found, then how many rows of all classes are
    nearer than that; mutual information is digamma(rows) + mean digamma(k) - mean digamma(class size) - mean digamma(of that
    count, the row itself included). No noise keeps equal values apart, so results repeat: where more than k rows of a class
    share a value, the number of them stands for k, which for a number with few values comes near the plug-in estimate.
    Interval ends are x - distance and x + distance as doubles. Classes with one row are left out, in classes of up to k rows all others are neighbours.

    Rows are first counted by column, class and value, so values of any frequency are one row each. Everything else works on
    ranges of these values, all columns together. NULL, NaN and infinite values and rows without a class are left out, column
    by column; a column with nothing left has NULL.
    """
    if neighbours < 1:
        raise ValueError("neighbours is at least 1")
    names = list(columns)
    held = df.where(named(target).isNotNull()).select(
        named(target).cast("string").alias("y"), F.array(*[number(c) for c in names]).alias("values"))
    tall = held.select("y", F.posexplode("values").alias("at", "x")).where("x IS NOT NULL AND abs(x) < double('Infinity')")
    cells = _ranged(tall.groupBy("at", "y", "x").agg(F.count(F.lit(1)).alias("n")), "at", "x")
    cells = cells.withColumn("group", F.concat_ws(":", "at", "y"))
    sizes = written(cells.groupBy("group").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("cells")), "class-sizes")
    sizes = sizes.withColumn("k", F.least(F.lit(neighbours), F.col("size") - 1))
    # not a join on the class alone: its partitioning would be kept by the windows, a common class in one task
    sized = attach(cells, sizes, "group", "cells").where("size > 1").drop("group")
    cells = written(_radii(sized, neighbours), "radii")
    joined = cells.join(_counts_within(cells), ["at", "y", "x"])
    n = F.col("n").cast("double")
    scores = joined.groupBy("at").agg(F.sum("n").alias("rows"), F.sum(
        n * (digamma(F.when(F.col("radius") == 0, F.col("n")).otherwise(F.col("k"))) - digamma(F.col("size")) - digamma(F.col("within")))).alias("total"))
    scores = scores.select("at", F.greatest(digamma(F.col("rows")) + F.col("total") / F.col("rows"), F.lit(0.0)).alias("mutual_info"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "at int, feature string")
    return listed.join(scores, "at", "left").select("feature", "mutual_info")
