"""Right-closed binning with fixed edges, and edges from quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def increasing(edges: Sequence[float | None]) -> bool:
    known = all(e is not None and not math.isnan(e) for e in edges)
    return known and all(a < b for a, b in zip(edges, edges[1:]))


def cut(value: Column, edges: Sequence[float], labels: Sequence[str],
        include_lowest: bool = False) -> Column:
    """Label of the bin ``(edge[i], edge[i+1]]`` that holds the value, else NULL.

    ``include_lowest`` also takes the lowest edge itself into the first bin.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per bin is needed")
    if not increasing(edges):
        raise ValueError(f"edges must increase: {list(edges)}")
    low, inner = edges[0], edges[1:]
    if low == -math.inf:
        inside = value.isNotNull()
    else:
        inside = (value >= F.lit(low)) if include_lowest else (value > F.lit(low))
    picked = None
    for upper, label in zip(inner, labels):
        test = inside if upper == math.inf else inside & (value <= F.lit(upper))
        picked = F.when(test, label) if picked is None else picked.when(test, label)
    return picked


def equal_width(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def labelled_quantiles(value: Column, edges: Sequence[float | None], labels: Sequence[str],
                       constant: str = "Medium") -> Column | None:
    """Quantile classes; equal-width classes when quantile edges collapse; one class for a constant.

    ``edges`` runs from the minimum to the maximum. Without any value there is nothing to label.
    """
    if not edges or edges[0] is None:
        return None
    if increasing(edges):
        return cut(value, edges, labels, include_lowest=True)
    if edges[-1] > edges[0]:
        return cut(value, equal_width(edges[0], edges[-1], len(labels)), labels, include_lowest=True)
    return F.lit(constant)


def sql_double(x: float) -> str:
    """A double as SQL text with all its digits."""
    if math.isinf(x):
        return f"double('{'-' if x < 0 else ''}Infinity')"
    return f"{x!r}D"


def interval_sql(value: str, bounds: Sequence[float], outcomes: Sequence[str]) -> str:
    """SQL for the outcome of the first bound at or above the value; the last is for the rest.

    A balanced tree of comparisons, so many intervals cost few tests per row. As text it also costs
    one call to the session, however many bounds there are.
    """
    if len(outcomes) != len(bounds) + 1:
        raise ValueError("one outcome more than bounds is needed")
    if not bounds:
        return outcomes[0]
    m = len(bounds) // 2
    return (f"if({value} <= {sql_double(bounds[m])}, {interval_sql(value, bounds[:m], outcomes[:m + 1])}, "
            f"{interval_sql(value, bounds[m + 1:], outcomes[m + 1:])})")


def bin_sql(value: str, edges: Sequence[float]) -> str:
    """SQL for the number of the right-closed bin between fitted edges; the outer bins are open."""
    inner = list(edges[1:-1])
    tree = interval_sql(value, inner, [str(i) for i in range(len(inner) + 1)])
    return f"if({value} IS NULL, NULL, {tree})"
