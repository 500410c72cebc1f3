"""Column typing, cleaning and alignment."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import fixed_values as V
from tabloom.functions.scalars import distinct_sketch, date_columns, is_numeric, named, numeric_columns, text_columns
from tabloom.functions.stats import fit_stats, modes


def role_by_name(column: str) -> str | None:
    for role, pattern in V.COLUMN_NAME_PATTERNS.items():
        if re.search(pattern, column):
            return role
    return None


def date_like_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Text columns in which some value starts like a date, in one pass over all rows."""
    if not columns:
        return set()
    pattern = "^(" + "|".join(V.DATE_TEXT_PATTERNS) + ")"
    found = df.agg(*[F.bool_or(named(c).rlike(pattern)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c for i, c in enumerate(columns) if found[f"c{i}"]}


def column_roles(df: DataFrame) -> dict[str, str]:
    """Likely business role per column: by name, else by the range of its values."""
    roles = {c: role_by_name(c) for c in df.columns}
    untyped = {c for c, r in roles.items() if r is None}
    numbers = [c for c in numeric_columns(df) if c in untyped]
    stats = fit_stats(df, {c: [] for c in numbers})
    for c in numbers:
        s = stats[c]
        positive = s.min is not None and s.min >= 0
        if s.distinct < 10 and positive and s.max <= 5:
            roles[c] = "rating"
        elif positive and s.max < 1000:
            roles[c] = "quantity"
        else:
            roles[c] = "numeric"
    texts = [c for c in text_columns(df) if c in untyped]
    dates = set(date_columns(df)) | date_like_columns(df, texts)
    rest = [c for c in df.columns if c in untyped and roles[c] is None]
    for c in rest:
        if c in dates:
            roles[c] = "date"
    open_columns = [c for c in rest if roles[c] is None]
    if open_columns:
        counted = df.agg(F.count(F.lit(1)).alias("__n"), *[
            distinct_sketch(named(c)).alias(c) for c in open_columns]).first()
        for c in open_columns:
            roles[c] = "category" if counted[c] < 0.01 * counted["__n"] else "text"
    return roles


def parses_as_timestamp(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns in which every known value reads as a timestamp."""
    if not columns:
        return []
    bad = df.agg(*[F.count_if(F.try_to_timestamp(named(c)).isNull() & named(c).isNotNull()).alias(c)
                   for c in columns], *[F.count(named(c)).alias(f"__{c}") for c in columns]).first()
    return [c for c in columns if bad[c] == 0 and bad[f"__{c}"] > 0]


def has_date_name(column: str) -> bool:
    return any(w in column.lower() for w in V.DATE_WORDS)


def clean_columns(df: DataFrame) -> DataFrame:
    """Names without outer spaces; text columns named like dates become timestamps if all parse."""
    df = df.toDF(*[c.strip() for c in df.columns])
    dates = parses_as_timestamp(df, [c for c in text_columns(df) if has_date_name(c)])
    return df.withColumns({c: F.try_to_timestamp(named(c)) for c in dates}) if dates else df


def to_number(c: str | Column) -> Column:
    """Number, or NULL where the text does not read as one."""
    return (named(c) if isinstance(c, str) else c).try_cast("double")


def numbers_where_whole(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns turned into numbers only where every known value reads as a number."""
    columns = list(columns if columns is not None else text_columns(df))
    if not columns:
        return df
    bad = df.agg(*[F.count_if(to_number(c).isNull() & named(c).isNotNull()).alias(c)
                   for c in columns]).first()
    whole = [c for c in columns if bad[c] == 0]
    return df.withColumns({c: to_number(c) for c in whole}) if whole else df


def typed_value(c: str | Column) -> Column:
    """Manual input as a struct of whole number, decimal number and text; one of them is set."""
    text = named(c) if isinstance(c, str) else c
    whole = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    decimal = F.when(whole.isNull(), text.try_cast("double"))
    rest = F.when(whole.isNull() & decimal.isNull(), text)
    return F.struct(whole.alias("whole"), decimal.alias("decimal"), rest.alias("text"))


def coerce_record(df: DataFrame, schema: Mapping[str, str]) -> DataFrame:
    """Features in model order from loose text input; missing ones become NULL."""
    return df.select(*[
        (named(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c)
        for c, kind in schema.items()])


def narrow_floats(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: named(c).cast("float") for c in doubles}) if doubles else df


def text_target(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, named(target).cast("string"))


def as_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: named(c).cast("string") for c in columns}) if columns else df


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with every numeric feature known."""
    return df.dropna(subset=list(columns if columns is not None else numeric_columns(df)))


def known_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(named(target).isNotNull())


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required features: {missing}")
    return df.select(*[named(c) for c in columns])


def align_columns(df: DataFrame, expected: Sequence[str], fill: float | None = 0) -> DataFrame:
    """Exactly the expected columns in order; absent ones filled with ``fill``."""
    filler = F.lit(fill) if fill is not None else F.lit(None).cast("double")
    return df.select(*[(named(c) if c in df.columns else filler).alias(c) for c in expected])


def align_one_hot(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected model inputs from raw columns: ``cat__<column>_<value>`` becomes a 0/1 test.

    The longest matching column name wins, so columns and values may hold underscores.
    """
    by_length = sorted(df.columns, key=len, reverse=True)
    made = []
    for name in expected:
        source = None
        if name.startswith("cat__"):
            rest = name[len("cat__"):]
            source = next((c for c in by_length if rest.startswith(c + "_")), None)
        if source is not None:
            value = rest[len(source) + 1:]
            made.append(F.coalesce((named(source).cast("string") == value).cast("int"), F.lit(0)))
        elif name in df.columns:
            made.append(named(name))
        else:
            made.append(F.lit(0))
    return df.select(*[m.alias(n) for m, n in zip(made, expected)])


def fill_typical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing numbers become the median, other missing values the most frequent one."""
    columns = list(columns or df.columns)
    kinds = {f.name: is_numeric(f) for f in df.schema}
    gaps = df.agg(*[F.count_if(named(c).isNull()).alias(c) for c in columns]).first()
    open_columns = [c for c in columns if gaps[c]]
    stats = fit_stats(df, {c: [0.5] for c in open_columns if kinds[c]})
    typical = {c: s.median for c, s in stats.items()}
    typical |= modes(df, [c for c in open_columns if not kinds[c]])
    return df.withColumns({c: F.coalesce(named(c), F.lit(v)) for c, v in typical.items()
                           if v is not None}) if typical else df


def numeric_features(df: DataFrame, target: str) -> list[str]:
    return numeric_columns(df, exclude=[target])


def valid_id(c: str) -> Column:
    return F.coalesce(named(c).rlike(V.UUID_PATTERN), F.lit(False))


def valid_or_new_id(c: str) -> Column:
    return F.when(valid_id(c), named(c)).otherwise(F.uuid())


def added_columns(before: Sequence[str], after: Sequence[str]) -> list[str]:
    known = set(before)
    return [c for c in after if c not in known]


def prefixed(df: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns renamed ``<block>__<column>`` in block order."""
    return df.select(*[named(c).alias(f"{block}__{c}") for block, cs in blocks.items() for c in cs])
