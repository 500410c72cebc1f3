"""Features fitted on one table and applied to any other, in batch or in a stream.

``fit`` takes a few aggregate jobs and leaves a list of feature specifications plus the column
statistics. ``transform`` is a projection: no job, no shuffle, the same code for streams.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.functions.bins import cut, equal_width, increasing
from tabloom.functions.scalars import (date_columns, flag, named, number, numeric_columns,
                                       text_columns)
from tabloom.functions.stats import ColumnStats, fit_stats
from tabloom.operators.columns import has_date_name, parses_as_timestamp
from tabloom.operators.profile import category_counts
from tabloom.operators.targets import date_parts, quartile_class, ratio, recency_features

INF = float("inf")
SHARES = [0, 0.25, 0.33, 0.5, 0.67, 0.75, 1]


@dataclass(frozen=True)
class Feature:
    """One generated column: what it is and the columns it reads."""

    name: str
    kind: str
    source: str
    other: str | None = None


def _labels(value: Column, edges: Sequence[float | None], labels: Sequence[str]) -> Column:
    """Fixed bins; where the fitted edges collapse no class can be told apart, so NULL."""
    if not increasing(edges):
        return F.lit(None).cast("string")
    return cut(value, edges, labels, include_lowest=True)


def bin_edges(kind: str, s: ColumnStats) -> tuple[list[float | None], list[str]]:
    """Edges and labels of the binned kinds, from fitted statistics alone."""
    if s.min is None:
        return [None, None], ["-"]
    span = s.max - s.min
    match kind:
        case "category":
            return s.edges(0, 0.25, 0.5, 0.75, 1), V.QUARTERS
        case "trend":
            return s.edges(0, 0.33, 0.67, 1), V.TREND
        case "tier":
            return equal_width(s.min, s.max, 4), V.TIER
        case "std_category":
            if s.std is None:
                return [None, None], ["-"]
            return [-INF, s.mean - s.std, s.mean - 0.5 * s.std, s.mean + 0.5 * s.std,
                    s.mean + s.std, INF], V.STD_CATEGORY
        case "price_strategy":
            return [*s.edges(0, 0.25, 0.5, 0.75), s.min + 0.9 * span, s.max], V.PRICE_STRATEGY
        case "stock_level":
            return [s.min, s.min + 0.2 * span, s.min + 0.5 * span, s.min + 0.8 * span,
                    s.max], V.FITTED_STOCK_LEVEL
        case "satisfaction":
            if s.max <= 5:
                return V.FIVE_POINT_EDGES, V.SATISFACTION
            if s.max <= 10:
                return V.TEN_POINT_EDGES, V.SATISFACTION
            return equal_width(s.min, s.max, 5), V.SATISFACTION
        case "nps_category":
            return V.NPS_EDGES, V.NPS
    raise ValueError(kind)


BINNED = ["category", "trend", "tier", "std_category", "price_strategy", "stock_level",
          "satisfaction", "nps_category"]


def _has(column: str, words: Sequence[str]) -> bool:
    return any(w in column.lower() for w in words)


@dataclass
class FeatureTransformer:
    """Fit on one table, transform many.

    ``target_only`` leaves out date and ratio features. ``reference_date`` (text or datetime)
    anchors recency; without it the moment of the transform does.
    """

    target_only: bool = False
    categorical_threshold: int = 10
    reference_date: str | None = None
    stats: dict[str, ColumnStats] = field(default_factory=dict)
    ratios: dict[str, ColumnStats] = field(default_factory=dict)
    categories: dict[str, dict[str, int]] = field(default_factory=dict)
    column_types: dict[str, str] = field(default_factory=dict)
    features: list[Feature] = field(default_factory=list)

    def fit(self, df: DataFrame) -> "FeatureTransformer":
        self.column_types = {f.name: f.dataType.simpleString() for f in df.schema}
        numbers = numeric_columns(df)
        self.stats = fit_stats(df, {c: SHARES for c in numbers})
        self.categories = category_counts(df, text_columns(df), self.categorical_threshold)
        dates = [c for c in date_columns(df) if has_date_name(c)]
        dates += parses_as_timestamp(df, [c for c in text_columns(df) if has_date_name(c)])
        self.features = self.plan(numbers, [] if self.target_only else dates)
        pairs = {f.name: f for f in self.features if f.kind == "ratio"}
        if pairs:
            made = df.select(*[ratio(f.source, f.other).alias(n) for n, f in pairs.items()])
            self.ratios = fit_stats(made, {n: [0.25, 0.5, 0.75] for n in pairs})
        return self

    def plan(self, numbers: Sequence[str], dates: Sequence[str]) -> list[Feature]:
        """Which features apply to which column, by statistics and by words in its name."""
        made = []
        for c in numbers:
            s = self.stats[c]
            kinds = ["zscore", "is_outlier", "is_high", "above_median"]
            if s.distinct > 3:
                kinds += ["category", "trend"]
                kinds += ["std_category"] if s.varies else []
                kinds += ["tier", "price_strategy"] if _has(c, V.FITTED_PRICE_WORDS) else []
                kinds += ["stock_level"] if _has(c, V.FITTED_STOCK_WORDS) else []
                if _has(c, V.FITTED_RATING_WORDS):
                    kinds.append("satisfaction")
                    kinds += ["nps_category"] if s.max <= 10 and s.min >= 0 else []
            made += [Feature(f"{c}_{k}", k, c) for k in kinds]
        for c in dates:
            made += [Feature(f"{c}_{k}", k, c) for k in (
                "year", "month", "quarter", "is_weekend", "recency_days", "recency_category")]
        if not self.target_only:
            for p in [c for c in numbers if _has(c, V.FITTED_PRICE_WORDS)]:
                for q in [c for c in numbers if _has(c, V.FITTED_QUANTITY_WORDS)]:
                    made += [Feature(f"{p}_per_{q}", "ratio", p, q),
                             Feature(f"{p}_per_{q}_category", "ratio_category", p, q)]
        return made

    @property
    def generated_columns(self) -> list[str]:
        return [f.name for f in self.features]

    def column(self, f: Feature) -> Column:
        if f.kind in ("ratio", "ratio_category"):
            value = ratio(f.source, f.other)
            if f.kind == "ratio":
                return value
            inner = self.ratios[f"{f.source}_per_{f.other}"].edges(0.25, 0.5, 0.75)
            return _labels(value, [-INF, *inner, INF], V.QUARTERS)
        if f.source not in self.stats:
            return self._date_features(f.source)[f.name]
        s, v = self.stats[f.source], number(f.source)
        if f.kind in BINNED:
            return _labels(v, *bin_edges(f.kind, s))
        if f.kind in ("is_high", "above_median"):
            return flag(v > F.lit(s.median))
        z = (v - F.lit(s.mean)) / F.lit(s.std) if s.varies else F.lit(None).cast("double")
        return z if f.kind == "zscore" else flag(F.abs(z) > 2)

    def _date_features(self, c: str) -> dict[str, Column]:
        reference = (F.lit(self.reference_date).cast("timestamp_ntz") if self.reference_date
                     else F.current_timestamp())
        text = self.column_types.get(c) == "string"
        moment = F.try_to_timestamp(named(c)) if text else named(c)
        return date_parts(c, moment) | recency_features(c, reference, moment)

    def transform(self, df: DataFrame, return_merged: bool = True) -> DataFrame:
        if not self.features:
            raise ValueError("fit must be called before transform")
        made = [self.column(f).alias(f.name) for f in self.features]
        kept = [named(c) for c in df.columns] if return_merged else []
        return df.select(*kept, *made)

    def fit_transform(self, df: DataFrame, return_merged: bool = True) -> DataFrame:
        return self.fit(df).transform(df, return_merged)

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON record in a folder every executor can reach."""
        state = {"target_only": self.target_only, "reference_date": self.reference_date,
                 "categorical_threshold": self.categorical_threshold,
                 "stats": {c: s.as_dict() for c, s in self.stats.items()},
                 "ratios": {c: s.as_dict() for c, s in self.ratios.items()},
                 "categories": self.categories, "column_types": self.column_types,
                 "features": [asdict(f) for f in self.features]}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureTransformer":
        state = json.loads(spark.read.text(path).first()["value"])
        return cls(
            target_only=state["target_only"], reference_date=state["reference_date"],
            categorical_threshold=state["categorical_threshold"],
            stats={c: ColumnStats.from_dict(s) for c, s in state["stats"].items()},
            ratios={c: ColumnStats.from_dict(s) for c, s in state["ratios"].items()},
            categories=state["categories"], column_types=state["column_types"],
            features=[Feature(**f) for f in state["features"]])
