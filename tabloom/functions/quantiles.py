"""Exact quantiles that never hold a whole column in one task.

The built-in ``percentile`` keeps one map of distinct values, so it serves columns with a small
(estimated) number of distinct values, whatever their row count. For the others the wanted ranks
are narrowed down: a bounded sketch proposes values around each rank, one counting scan proves
between which of them the rank lies, and this repeats until every span of values holds few enough
rows to be sorted. Every step is a scan with map-side aggregation; rows are not shuffled and ties
of any size are harmless. A thousand billion rows take three rounds.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.bins import interval_sql, sql_double
from tabloom.functions.scalars import distinct_sketch, number

MAP_VALUES = 50_000        # distinct values the built-in aggregate may hold
SPAN_ROWS = 20_000         # rows of one span that may be sorted together
SKETCH_ACCURACY = 10_000

Wanted = Mapping[str, Sequence[float]]
Answer = dict[str, dict[float, float | None]]


@dataclass(frozen=True)
class Extent:
    """What a first scan knows of a column."""

    known: int
    low: float | None
    high: float | None
    distinct: int  # estimated within about one percent


@dataclass
class _Span:
    """Closed value range [low, high] known to hold the rows of some ranks (zero-based)."""

    column: int
    low: float
    high: float
    below: int     # rows under ``low``
    inside: int    # rows within the span
    ranks: list[int]
    stalled: bool = False


def extent_columns(columns: Iterable[str]) -> list[Column]:
    """Count, range and estimated number of distinct values."""
    return [measure.alias(f"{c}_{name}") for c in columns for name, measure in (
        ("known", F.count(c)), ("low", F.min(c)), ("high", F.max(c)), ("distinct", distinct_sketch(F.col(c))))]


def read_extent(row, key: str) -> Extent:
    return Extent(row[f"{key}_known"], row[f"{key}_low"], row[f"{key}_high"], row[f"{key}_distinct"])


def quantiles(df: DataFrame, wanted: Wanted, extents: Mapping[str, Extent] | None = None,
              map_values: int = MAP_VALUES, span_rows: int = SPAN_ROWS,
              accuracy: int = SKETCH_ACCURACY) -> Answer:
    """Linearly interpolated quantiles of several numeric columns."""
    wanted = {c: sorted(set(map(float, p))) for c, p in wanted.items() if p}
    if not wanted:
        return {}
    keys = {c: f"c{i}" for i, c in enumerate(wanted)}
    slim = df.select(*[number(c).alias(k) for c, k in keys.items()])
    if extents is None:
        m = slim.agg(*extent_columns(keys.values())).first()
        extents = {c: read_extent(m, k) for c, k in keys.items()}
    few = {keys[c]: p for c, p in wanted.items() if extents[c].distinct <= map_values}
    many = {keys[c]: p for c, p in wanted.items() if extents[c].distinct > map_values}
    found: Answer = {}
    if few:
        found |= read_maps(slim.agg(*map_columns(few)).first(), few)
    if many:
        sizes = {keys[c]: e for c, e in extents.items() if c in keys}
        found |= _narrowed(slim, many, sizes, span_rows, accuracy)
    return {c: found[k] for c, k in keys.items()}


def map_columns(wanted: Wanted) -> list[Column]:
    return [F.expr(f"percentile({c}, array({', '.join(sql_double(float(p)) for p in shares)}))").alias(c)
            for c, shares in wanted.items()]


def read_maps(row, wanted: Wanted) -> Answer:
    return {c: dict(zip(shares, row[c] or [None] * len(shares))) for c, shares in wanted.items()}


def _narrowed(slim: DataFrame, wanted: Wanted, extents: Mapping[str, Extent],
              span_rows: int, accuracy: int) -> Answer:
    columns = list(wanted)
    slim = slim.select(*columns)
    places = {(c, p): p * (extents[c].known - 1) for c, shares in wanted.items() for p in shares
              if extents[c].known}
    value: dict[tuple[int, int], float] = {}
    waiting: list[_Span] = []
    for i, c in enumerate(columns):
        e = extents[c]
        last = e.known - 1
        ranks = {r for (k, _), at in places.items() if k == c for r in (math.floor(at), math.ceil(at))}
        value |= {(i, r): e.low if r == 0 else e.high for r in ranks if r in (0, last)}
        inner = sorted(ranks - {0, last})
        if inner:
            waiting.append(_Span(i, e.low, e.high, 0, e.known, inner))
    small: list[_Span] = []
    while waiting:
        wide = []
        for s in waiting:
            if s.low == s.high:
                value |= {(s.column, r): s.low for r in s.ranks}
            else:
                (small if s.inside <= span_rows else wide).append(s)
        waiting = _narrow(slim, wide, accuracy) if wide else []
    if small:
        value |= _read_ranks(slim, small)
    answer: Answer = {c: dict.fromkeys(shares) for c, shares in wanted.items()}
    for (c, p), at in places.items():
        i = columns.index(c)
        lower, upper = value[i, math.floor(at)], value[i, math.ceil(at)]
        answer[c][p] = lower if lower == upper else (
            (math.ceil(at) - at) * lower + (at - math.floor(at)) * upper)
    return answer


def _tall(slim: DataFrame, codes: Mapping[int, Column]) -> DataFrame:
    """Rows ``(column, code, v)`` of the columns that have a code expression."""
    parts = [F.struct(F.lit(i).alias("column"), code.alias("code"), F.col(slim.columns[i]).alias("v"))
             for i, code in codes.items()]
    return slim.select(F.explode(F.array(*parts)).alias("e")).select("e.*").where("code IS NOT NULL")


def _span_codes(slim: DataFrame, spans: list[_Span]) -> dict[int, Column]:
    """Number of the span that holds a value. The spans of a column do not overlap."""
    codes = {}
    for i in {s.column for s in spans}:
        mine = sorted((s.low, s.high, n) for n, s in enumerate(spans) if s.column == i)
        v = slim.columns[i]
        outcomes = [f"if({v} >= {sql_double(low)}, {n}, NULL)" for low, _, n in mine]
        codes[i] = F.expr(interval_sql(v, [high for _, high, _ in mine], [*outcomes, "NULL"]))
    return codes


GRID = 500
LARGEST = sys.float_info.max


def _narrow(slim: DataFrame, spans: list[_Span], accuracy: int) -> list[_Span]:
    """One sketching and one counting scan; every span splits into smaller ones around its ranks."""
    grid = [g / GRID for g in range(GRID + 1)]
    few = len(spans) == len({s.column for s in spans})
    shares = {n: _near(s, accuracy) if few else grid for n, s in enumerate(spans)}
    tall = _tall(slim, _span_codes(slim, spans))
    asked = sorted({p for held in shares.values() for p in held})
    sketched = {r["code"]: dict(zip(asked, r["q"])) for r in tall.groupBy("code").agg(
        F.expr(f"percentile_approx(v, array({', '.join(map(sql_double, asked))}), {accuracy})").alias("q")).collect()}
    points: dict[int, set[float]] = {}
    for n, s in enumerate(spans):
        found = points.setdefault(s.column, set())
        found |= {sketched[n][p] for p in (shares[n] if few else _around(s))}
        if s.stalled:
            found.add(max(s.low, -LARGEST) / 2 + min(s.high, LARGEST) / 2)
    counts = _counts(slim, {i: sorted(p) for i, p in points.items()})
    made: list[_Span] = []
    for s in spans:
        for rank in s.ranks:
            low, below, high, end = s.low, s.below, s.high, s.below + s.inside
            for v, under, upto in counts[s.column]:
                if under <= rank and v > low:
                    low, below = v, under
                if upto > rank and v < high:
                    high, end = v, upto
                    break
            made.append(_Span(s.column, low, high, below, end - below, [rank], (low, high) == (s.low, s.high)))
    return _merged(made)


def _near(s: _Span, accuracy: int) -> list[float]:
    slack = 2.0 / accuracy
    return sorted({min(1.0, max(0.0, (r - s.below) / s.inside + d)) for r in s.ranks for d in (-slack, slack)})


def _around(s: _Span) -> list[float]:
    """Grid shares one step outside those that enclose each rank."""
    steps = set()
    for r in s.ranks:
        at = (r - s.below) / s.inside * GRID
        steps |= {max(0, math.floor(at) - 1), min(GRID, math.ceil(at) + 1)}
    return [g / GRID for g in sorted(steps)]


def _counts(slim: DataFrame, points: dict[int, list[float]]) -> dict[int, list[tuple[float, int, int]]]:
    """Rows under and rows up to each point, from the row counts of the intervals between points."""
    codes = {}
    for i, held in points.items():
        v = slim.columns[i]
        at = [f"if({v} = {sql_double(p)}, {2 * j + 1}, {2 * j})" for j, p in enumerate(held)]
        codes[i] = F.expr(f"if({v} IS NULL, NULL, {interval_sql(v, held, [*at, str(2 * len(held))])})")
    counted = _tall(slim, codes).groupBy("column", "code").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = {(r["column"], r["code"]): r["n"] for r in counted}
    answer: dict[int, list[tuple[float, int, int]]] = {}
    for i, held in points.items():
        total, listed = 0, []
        for j, p in enumerate(held):
            under = total + rows.get((i, 2 * j), 0)
            total = under + rows.get((i, 2 * j + 1), 0)
            listed.append((p, under, total))
        answer[i] = listed
    return answer


def _merged(spans: list[_Span]) -> list[_Span]:
    """Overlapping spans of a column made one, so that each row belongs to one span."""
    kept: list[_Span] = []
    for s in sorted(spans, key=lambda s: (s.column, s.low, s.high)):
        last = kept[-1] if kept else None
        if last and last.column == s.column and s.low <= last.high:
            end = max(last.below + last.inside, s.below + s.inside)
            kept[-1] = replace(last, high=max(last.high, s.high), inside=end - last.below,
                               ranks=last.ranks + s.ranks, stalled=last.stalled or s.stalled)
        else:
            kept.append(s)
    return kept


def _read_ranks(slim: DataFrame, spans: list[_Span]) -> dict[tuple[int, int], float]:
    """Sort the few rows of each span, whose number was counted before, and pick the ranks."""
    listed = ", ".join(f"{n}, array({', '.join(str(r - s.below + 1) for r in s.ranks)})" for n, s in enumerate(spans))
    places = F.expr(f"map({listed})")
    held = (_tall(slim, _span_codes(slim, spans)).groupBy("code")
            .agg(F.array_sort(F.collect_list("v")).alias("sorted")))
    picked = held.select("code", F.transform(F.element_at(places, F.col("code")),
                                             lambda at: F.element_at("sorted", at.cast("int"))).alias("values"))
    return {(spans[r["code"]].column, rank): v for r in picked.collect()
            for rank, v in zip(spans[r["code"]].ranks, r["values"])}
