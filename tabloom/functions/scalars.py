"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The top-level column ``name``, also where the name holds dots or spaces."""
    return F.col(quoted(name))


def as_column(value: str | Column) -> Column:
    return named(value) if isinstance(value, str) else value


def number(value: str | Column) -> Column:
    """As double with NaN made NULL, so that one kind of missing value is left."""
    c = as_column(value).cast("double")
    return F.when(~F.isnan(c), c)


def is_numeric(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f) and f.name not in exclude]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def date_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in exclude]


def split_by_kind(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    return {"numeric": numeric_columns(df, exclude), "text": text_columns(df, exclude),
            "date": date_columns(df, exclude)}


def flag(condition: Column) -> Column:
    """Comparison as 0/1 where an unknown comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def weekend(day: Column) -> Column:
    return flag(F.weekday(day) >= 5)


def timestamp_micros(moment: Column) -> Column:
    """Microseconds of the wall-clock time since 1970, whatever the time zone of the session."""
    return F.unix_micros(F.from_utc_timestamp(moment.cast("timestamp"), F.current_timezone()))


def whole_days(start: Column, end: Column) -> Column:
    """Full 24-hour days from ``start`` to ``end``, rounded down."""
    gap = timestamp_micros(end) - timestamp_micros(start)
    return F.floor(gap / F.lit(MICROS_PER_DAY)).cast("bigint")


def epoch_nanos(moment: Column) -> Column:
    return timestamp_micros(moment) * F.lit(1000)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; a zero divisor gives NULL."""
    return top / F.when(bottom != 0, bottom)


def text_length(text: Column) -> Column:
    """Characters of the text; a missing text counts as the three letters of ``nan``."""
    return F.length(F.coalesce(text, F.lit("nan")))


def min_max(value: Column, low: float, high: float) -> Column:
    return (value - F.lit(low)) / F.lit(high - low)


def row_mean(columns: Sequence[Column]) -> Column:
    """Mean across columns that skips NULL."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    known = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return safe_ratio(total, known)


def clean_name(text: Column) -> Column:
    """Everything but letters and digits becomes an underscore."""
    return F.regexp_replace(text, r"[^0-9A-Za-z]", "_")


def four_decimals(value: Column) -> Column:
    return F.format_string("%.4f", value.cast("double"))


def percent_text(share: Column) -> Column:
    return F.format_string("%.2f%%", share.cast("double") * 100)


def hash_unit(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for a row key, the same on every engine with MD5."""
    return F.conv(F.substring(hash_text(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_text(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def null_ratio(c: Column) -> Column:
    return F.avg(c.isNull().cast("double"))


def category_code(c: Column, values: Sequence) -> Column:
    """Position among the sorted values, -1 for missing or unknown ones."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(position > 0, position - 1).otherwise(F.lit(-1)).cast("int")


def distinct_sketch(c: Column) -> Column:
    """About how many distinct values there are, within one percent; exact for small numbers.

    The sketch is one binary buffer, which aggregates far faster than the built-in estimate at this
    precision.
    """
    held = F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(14))
    return F.coalesce(F.hll_sketch_estimate(held), F.lit(0).cast("bigint"))
