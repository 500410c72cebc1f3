"""Lookups by key that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import as_column, named
from tabloom.session import checkpoint

BROADCAST_BYTES = 64 * 1024 * 1024
SPRINKLE = 64          # places over which the rows of a hot key are spread
HOT_SHARE = 0.001      # a key with more than this share of the rows is handled apart


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row as it is held in memory; texts, arrays, maps and structs by what they hold."""
    sizes = [F.lit(16)]
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(named(f.name)), F.lit(0)) + 8)
        elif kind in ("array", "map", "struct"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(named(f.name)))), F.lit(0)) + 8)
        else:
            sizes.append(F.lit(16 if kind == "decimal" else 8))
    return reduce(add, sizes)


def fits_broadcast(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether all rows together, by their real lengths, are within the limit."""
    return (df.agg(F.sum(row_bytes(df).cast("bigint"))).first()[0] or 0) <= limit_bytes


def attach(rows: DataFrame, table: DataFrame, key: str, weight: str | None = None,
           limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of ``rows`` with the one-row-per-key ``table``.

    A table whose bytes were counted to be under ``limit_bytes`` is broadcast. A larger one is shuffled: rows without a
    key get theirs from a sprinkling number and meet nothing, and the keys whose row count in ``weight`` exceeds
    ``HOT_SHARE`` of all rows (at most ``1 / HOT_SHARE``) are copied to ``SPRINKLE`` places over which their rows are
    spread. Either way ``rows`` is read once.
    """
    values = table.drop(weight) if weight else table
    if fits_broadcast(values, limit_bytes):
        return rows.join(F.broadcast(values), key, "left")
    table = checkpoint(table)  # read by several of the next steps
    values = table.drop(weight) if weight else table
    hot = []
    if weight:
        total = table.agg(F.sum(weight)).first()[0] or 0
        hot = [r[key] for r in table.where(named(weight) > HOT_SHARE * total).select(key).collect()]
    number = F.pmod(F.xxhash64(*[named(c) for c in rows.columns]), F.lit(SPRINKLE)).cast("int")
    is_hot = F.coalesce(named(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    left = rows.withColumn("__spread", F.when(named(key).isNull() | is_hot, number).otherwise(F.lit(0)))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SPRINKLE - 1))).otherwise(F.array(F.lit(0)))
    right = values.withColumn("__spread", F.explode(copies))
    return left.join(right, [key, "__spread"], "left").drop("__spread")


def group_values(df: DataFrame, key: str, measures: Mapping[str, Column],
                 limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row with the aggregates of its group, without a window over the group.

    Aggregation combines on the map side, so a hot key costs one row per task.
    """
    grouped = (df.where(named(key).isNotNull()).groupBy(named(key))
               .agg(*[m.alias(n) for n, m in measures.items()],
                    F.count(F.lit(1)).alias("__rows")))
    return attach(df, grouped, key, "__rows", limit_bytes)


def look_up(value: str | Column, names: Mapping, default: str | None = None) -> Column:
    """Value replaced through a small fixed mapping, with a default for the rest."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    found = F.element_at(F.create_map(*pairs), as_column(value))
    return F.coalesce(found, F.lit(default)) if default is not None else found


def only_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, one per key. Keys are made distinct first, so a repeated one weighs nothing.

    Of rows that repeat a key inside ``new`` the first in order of their other values stays.
    """
    left = new.join(existing.select(key).distinct(), key, "left_anti")
    others = [c for c in new.columns if c != key]
    if not others:
        return left.dropDuplicates([key])
    order = F.to_json(F.struct(*[named(c) for c in others]))
    first = left.groupBy(named(key)).agg(F.min_by(F.struct(*[named(c) for c in others]), order).alias("__first"))
    return first.select(named(key), "__first.*").select(*[named(c) for c in new.columns])


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(parents.select(named(parent_key).alias(key)).distinct(), key, "left_semi")


def compare_predictions(actual: DataFrame, predicted: DataFrame, key: str,
                        label: str, prediction: str) -> DataFrame:
    """Rows, hits and accuracy of predictions joined to the actual labels by row key."""
    both = actual.select(key, label).join(predicted.select(key, prediction), key)
    hit = (named(label) == named(prediction)).cast("int")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.sum(hit).alias("hits"),
                    F.avg(hit.cast("double")).alias("accuracy"))


def missing_labels(full: DataFrame, part: DataFrame, label: str) -> DataFrame:
    """Labels of ``full`` that never occur in ``part``."""
    return full.select(label).distinct().join(part.select(label).distinct(), label, "left_anti")


def latest(df: DataFrame, moment: str, n: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Newest first; with ``n`` only the newest ``n``, kept by partial top-n per task."""
    ordered = df.orderBy(F.desc(moment), *[F.asc(t) for t in tie])
    return ordered.limit(n) if n is not None else ordered
