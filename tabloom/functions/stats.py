"""Fused column statistics: one aggregate for moments, one for quantiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions import quantiles as Q
from tabloom.functions.scalars import named, number

# under this estimate the distinct count is taken exactly
EXACT_DISTINCT_BELOW = 60


@dataclass
class ColumnStats:
    rows: int
    known: int
    distinct: int            # exact when small, else estimated within about one percent
    mean: float | None
    std: float | None        # sample
    std_pop: float | None    # population
    min: float | None
    max: float | None
    quantile: dict[float, float | None] = field(default_factory=dict)

    def edges(self, *shares: float) -> list[float | None]:
        return [self.quantile.get(float(p)) for p in shares]

    @property
    def median(self) -> float | None:
        return self.quantile.get(0.5)

    @property
    def varies(self) -> bool:
        return bool(self.std) and self.std > 0

    def as_dict(self) -> dict:
        return asdict(self) | {"quantile": {str(k): v for k, v in self.quantile.items()}}

    @classmethod
    def from_dict(cls, stored: Mapping) -> "ColumnStats":
        held = dict(stored)
        held["quantile"] = {float(k): v for k, v in (held.get("quantile") or {}).items()}
        return cls(**held)


def fit_stats(df: DataFrame, wanted: Mapping[str, Sequence[float]],
              map_values: int = Q.MAP_VALUES) -> dict[str, ColumnStats]:
    """Statistics of numeric columns; ``wanted`` names the quantiles needed per column."""
    if not wanted:
        return {}
    keys = {name: f"c{i}" for i, name in enumerate(wanted)}
    slim = df.select(*[number(name).alias(k) for name, k in keys.items()])
    m = slim.agg(F.count(F.lit(1)).alias("rows"), *Q.extent_columns(keys.values()),
                 *[measure(k).alias(f"{k}_{part}") for k in keys.values() for part, measure in (
                     ("mean", F.avg), ("std", F.stddev_samp), ("std_pop", F.stddev_pop))]).first()
    extents = {k: Q.read_extent(m, k) for k in keys.values()}
    stats = {}
    for name, k in keys.items():
        e = extents[k]
        stats[name] = ColumnStats(m["rows"], e.known, e.distinct, m[f"{k}_mean"], m[f"{k}_std"],
                                  m[f"{k}_std_pop"], e.low, e.high)
    shares = {k: sorted(set(map(float, wanted[name]))) for name, k in keys.items() if wanted[name]}
    tiny = [name for name in keys if stats[name].distinct < EXACT_DISTINCT_BELOW]
    few = {k: p for k, p in shares.items() if extents[k].distinct <= map_values}
    many = {k: p for k, p in shares.items() if k not in few}
    # a set of a column with few values stays small, so it needs no shuffle of its own
    second = Q.map_columns(few) + [
        F.size(F.collect_set(keys[name])).alias(f"{keys[name]}_exact") for name in tiny]
    answer: Q.Answer = {}
    if second:
        found = slim.agg(*second).first()
        answer = Q.read_maps(found, few)
        for name in tiny:
            stats[name].distinct = found[f"{keys[name]}_exact"]
    if many:
        answer |= Q.quantiles(slim, many, extents, map_values=map_values)
    for name, k in keys.items():
        stats[name].quantile = answer.get(k, {})
    return stats


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Most frequent known value per column, the smallest one on ties.

    Values are counted per key and every task keeps its best one, so no task ever holds a whole
    column of distinct values. Columns of one type share a job.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    by_kind: dict[str, list[str]] = {}
    for c in columns:
        by_kind.setdefault(kinds[c].simpleString(), []).append(c)
    found: dict[str, object] = dict.fromkeys(columns)
    for members in by_kind.values():
        tops = None
        for c in members:
            counts = (df.select(named(c).alias("v")).where("v IS NOT NULL")
                      .groupBy("v").agg(F.count(F.lit(1)).alias("n")))
            top = counts.orderBy(F.desc("n"), F.asc("v")).limit(1).select(F.lit(c).alias("c"), "v")
            tops = top if tops is None else tops.unionByName(top)
        found |= {r["c"]: r["v"] for r in tops.collect()}
    return found
