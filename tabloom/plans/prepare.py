"""Fitted preprocessing as a native, storable ML pipeline that ends in a ``features`` vector.

Statistics become literals of SQL stages, so applying the pipeline is a projection without Python.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, TargetEncoder,
                                VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import (date_columns, epoch_nanos, named, numeric_columns, quoted, text_columns,
                                       whole_days)
from tabloom.functions.stats import fit_stats, modes
from tabloom.operators.association import mutual_information
from tabloom.operators.encode import choose_encoding, frequent_values, split_by_cardinality
from tabloom.operators.fitted import FeatureTransformer

CORRELATIONS = 200            # correlations per aggregate
EPOCH = "__epoch"             # ends the names of dates as numbers


@dataclass(frozen=True)
class Encoded:
    """One slot of the feature vector and the source column it comes from."""

    name: str
    source: str


@dataclass
class Preprocessor:
    model: PipelineModel
    slots: list[Encoded]
    target: str | None = None
    encoding: str | None = None

    @property
    def feature_names(self) -> list[str]:
        return [s.name for s in self.slots]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    def wide(self, df: DataFrame, names: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
        """Features as plain columns after the kept ones; generic names when ``names`` does not match."""
        names = list(names if names is not None else self.feature_names)
        if len(names) != len(self.slots):
            names = [f"feature_{i}" for i in range(len(self.slots))]
        array = vector_to_array("features")
        return self.transform(df).select(*[named(c) for c in keep], *[array[i].alias(n) for i, n in enumerate(names)])

    def info(self) -> str:
        return json.dumps({"slots": [asdict(s) for s in self.slots], "target": self.target,
                           "encoding": self.encoding})

    @classmethod
    def load(cls, model: PipelineModel, info: str) -> "Preprocessor":
        held = json.loads(info)
        return cls(model, [Encoded(**s) for s in held["slots"]], held["target"], held["encoding"])


def _sql(expressions: dict[str, str]) -> SQLTransformer:
    made = ", ".join(f"{e} AS {quoted(n)}" for n, e in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")


def epoch_sql(column: str) -> str:
    """Nanoseconds since 1970 of a date, a moment, or a text that reads as one."""
    return (f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', "
            f"try_cast({quoted(column)} AS TIMESTAMP_NTZ)) * 1000")


def _text(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def number_stage(df: DataFrame, columns: Sequence[str], impute: str = "median",
                 rescale: bool = True) -> tuple[SQLTransformer, list[str]]:
    """Imputed and scaled numbers (by the population deviation after imputing)."""
    stats = fit_stats(df, {c: [0.5] if impute == "median" else [] for c in columns})
    made = {}
    for c, s in stats.items():
        fill = (s.median if impute == "median" else s.mean) or 0.0
        known, rows = s.known, max(s.rows, 1)
        mean = ((s.mean or 0.0) * known + fill * (rows - known)) / rows
        spread = (((s.std_pop or 0.0) ** 2 + (s.mean or 0.0) ** 2) * known + fill ** 2 * (rows - known)) / rows
        sd = max(spread - mean * mean, 0.0) ** 0.5
        clean = f"CASE WHEN isnan(CAST({quoted(c)} AS DOUBLE)) THEN NULL ELSE CAST({quoted(c)} AS DOUBLE) END"
        filled = f"coalesce({clean}, {fill!r}D)"
        made[f"num__{c}"] = f"({filled} - {mean!r}D) / {sd if sd > 1e-12 else 1.0!r}D" if rescale else filled
    return _sql(made), list(made)


def build_preprocessor(df: DataFrame, target: str | None = None, *, numbers: Sequence[str] | None = None,
                       categories: Sequence[str] | None = None, max_categories: int = 20,
                       max_dummy_features: int = 1000, encoding: str = "auto", impute: str = "median",
                       rescale: bool = True, limit_per_column: int | None = None,
                       label: str = "label", high: Sequence[str] | None = None,
                       dates: Sequence[str] = (), dictionary_values: int | None = None,
                       classes: int | None = None) -> Preprocessor:
    """Numbers imputed and scaled; narrow categories one-hot; wide ones encoded by ``encoding``.

    ``encoding`` is ``target``, ``hashing``, ``ordinal``, ``binary`` or ``auto``. ``limit_per_column``
    keeps one-hot columns per category by merging rare values. ``target`` encoding reads the numeric
    column ``label``. ``dates`` become nanoseconds since 1970 and then count as numbers. Only with
    ``dictionary_values`` are columns of more values than that hashed whatever ``encoding`` says. ``classes`` tells ``auto``
    how many classes a numbered target stands for.
    """
    skip = [c for c in (target, label) if c]
    numbers = list(numbers if numbers is not None else numeric_columns(df, skip))
    categories = list(categories if categories is not None else text_columns(df, skip))
    if high is None and limit_per_column is None:
        low, wide, sizes = split_by_cardinality(df, categories, max_categories, max_dummy_features)
    else:
        wide = [c for c in categories if c in (high or ())]
        low, sizes = [c for c in categories if c not in wide], {}
    stages: list[Transformer] = []
    inputs: list[str] = []
    slots: list[Encoded] = []
    if dates:
        stages.append(_sql({f"{c}{EPOCH}": epoch_sql(c) for c in dates}))
        df = stages[-1].transform(df)
    if numbers or dates:
        columns = {**{c: c for c in numbers}, **{f"{c}{EPOCH}": c for c in dates}}
        stage, made = number_stage(df, list(columns), impute, rescale)
        stages.append(stage)
        inputs += made
        slots += [Encoded(m, c) for m, c in zip(made, columns.values())]
    huge = [c for c in wide if dictionary_values is not None and sizes.get(c, 0) > dictionary_values]
    kept = [c for c in wide if c not in huge]
    if encoding == "auto":
        encoding = _auto_encoding(df, target, kept, classes)
    if encoding == "hashing":
        huge, kept = [*kept, *huge], []
    if low or wide:
        fill = modes(df, [*low, *kept])
        prepared = {}
        for c in [*low, *kept]:
            value = f"coalesce({quoted(c)}, {_text(fill[c])})" if fill[c] is not None else quoted(c)
            if c in low and limit_per_column:
                values, other = frequent_values(df, c, limit_per_column)
                if other:
                    value = (f"CASE WHEN {value} IN ({', '.join(map(_text, values))}) THEN {value} "
                             "ELSE 'infrequent' END")
            prepared[f"__{c}"] = value
        for c in huge:
            prepared[f"__{c}"] = f"coalesce({quoted(c)}, '')"
        stages.append(_sql(prepared))
        df = stages[-1].transform(df)
    if low:
        indexer = StringIndexer(inputCols=[f"__{c}" for c in low], outputCols=[f"__{c}_i" for c in low],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        coder = OneHotEncoder(inputCols=[f"__{c}_i" for c in low], outputCols=[f"cat__{c}" for c in low],
                              dropLast=True)
        indexed = indexer.transform(df)
        stages += [indexer, coder.fit(indexed)]
        inputs += [f"cat__{c}" for c in low]
        for c, values in zip(low, indexer.labelsArray):
            # the dropped last slot is the one of unknown values
            slots += [Encoded(f"cat__{c}_{v}", c) for v in values]
    if kept:
        indexer = StringIndexer(inputCols=[f"__{c}" for c in kept], outputCols=[f"__{c}_k" for c in kept],
                                stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
        stages.append(indexer)
        if encoding == "target":
            kind = "binary" if df.select(label).where(F.col(label) > 1).limit(1).count() == 0 else "continuous"
            coder = TargetEncoder(inputCols=[f"__{c}_k" for c in kept], outputCols=[f"cat_high__{c}" for c in kept],
                                  labelCol=label, targetType=kind, smoothing=1.0, handleInvalid="keep")
            stages.append(coder.fit(indexer.transform(df)))
        elif encoding == "ordinal":
            made = {}
            for c, values in zip(kept, indexer.labelsArray):
                index = quoted(f"__{c}_k")
                made[f"cat_high__{c}"] = f"CASE WHEN {index} >= {len(values)} THEN -1D ELSE {index} END"
            stages.append(_sql(made))
        elif encoding == "binary":
            made = {}
            for c, values in zip(kept, indexer.labelsArray):
                bits, index = max(1, len(values).bit_length()), quoted(f"__{c}_k")
                code = f"CASE WHEN {index} >= {len(values)} THEN 0 ELSE CAST({index} AS INT) + 1 END"
                for b in reversed(range(bits)):
                    made[f"cat_high__{c}_{bits - 1 - b}"] = f"CAST((({code}) & {1 << b}) != 0 AS DOUBLE)"
            stages.append(_sql(made))
            inputs += list(made)
            slots += [Encoded(n, next(c for c in sorted(kept, key=len, reverse=True)
                                      if n.startswith(f"cat_high__{c}_"))) for n in made]
        else:
            raise ValueError(f"unknown encoding {encoding}")
        if encoding != "binary":
            inputs += [f"cat_high__{c}" for c in kept]
            slots += [Encoded(f"cat_high__{c}", c) for c in kept]
    if huge:
        width = min(50, 3 * len(huge))
        hasher = FeatureHasher(inputCols=[f"__{c}" for c in huge], outputCol="cat_high__hashed",
                               numFeatures=width, categoricalCols=[f"__{c}" for c in huge])
        stages.append(hasher)
        inputs.append("cat_high__hashed")
        slots += [Encoded(f"cat_high__hash_{i}", "+".join(huge)) for i in range(width)]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return Preprocessor(PipelineModel(stages), slots, target, encoding if wide else None)


def _auto_encoding(df: DataFrame, target: str | None, high: Sequence[str], classes: int | None = None) -> str:
    if target is None or not high:
        return "ordinal" if target is None else "target"
    if classes is not None:
        return choose_encoding(classes, high)
    known = df.select(named(target)).where(named(target).isNotNull()).distinct().limit(11).count()
    textual = target in text_columns(df)
    return choose_encoding(known if textual or known < 10 else None, high)


def create_preprocessor(df: DataFrame, numbers: Sequence[str] | None = None,
                        categories: Sequence[str] | None = None, target: str | None = None) -> Preprocessor:
    """Median and scale for numbers; most frequent value and at most ten one-hot columns for text."""
    return build_preprocessor(df, target, numbers=numbers, categories=categories, limit_per_column=10)


@dataclass
class PreparedFeatures:
    """Fitted features on top of imputed, scaled and one-hot encoded columns."""

    preprocessor: Preprocessor | None = None
    features: FeatureTransformer | None = None

    def fit(self, df: DataFrame, **options) -> "PreparedFeatures":
        self.preprocessor = create_preprocessor(df)
        self.features = FeatureTransformer(**options).fit(self.preprocessor.wide(df))
        return self

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return self.features.transform(self.preprocessor.wide(df, keep=keep))


def fallback_preprocessor(df: DataFrame, target: str) -> Preprocessor:
    """One-hot up to ten values, positions for wider columns."""
    return build_preprocessor(df, target, max_categories=10, encoding="ordinal")


def regression_preprocessor(df: DataFrame, target: str, most_values: int | None = None) -> Preprocessor:
    """All categories one-hot and all dates as numbers, inside the stored pipeline.

    With ``most_values`` columns of more values are target-encoded instead.
    """
    most = most_values or 2**31 - 1
    return build_preprocessor(df, target, max_categories=most, max_dummy_features=most, dates=date_columns(df))


def dates_as_numbers(df: DataFrame) -> DataFrame:
    """Date columns as nanoseconds since 1970."""
    made = {c: epoch_nanos(named(c)) for c in date_columns(df)}
    return df.withColumns(made) if made else df


def days_since(df: DataFrame, reference: str, drop: Sequence[str] = ()) -> DataFrame:
    """Date columns replaced by whole days up to a reference moment, ids dropped."""
    dates = date_columns(df)
    moment = F.lit(reference).cast("timestamp_ntz")
    return df.withColumns({f"{c}_days_since": whole_days(named(c), moment) for c in dates}) \
        .drop(*dates, *drop)


def select_features(p: Preprocessor, df: DataFrame, key: str, k: int, classification: bool,
                    label: str = "label") -> Preprocessor:
    """Constant slots removed, then the ``k`` best ones kept.

    Classes are scored by mutual information, numbers by an F test, both on all rows.
    """
    ready = p.transform(df)
    variance = ready.select(Summarizer.variance(F.col("features")).alias("v")).first()["v"].toArray()
    alive = [i for i in range(len(p.slots)) if variance[i] > 0]
    if len(alive) > k:
        if classification:
            array = vector_to_array("features")
            wide = ready.select(F.col(label).cast("string").alias("__y"), *[array[i].alias(f"s{i}") for i in alive])
            names = [f"s{i}" for i in alive]
            scored = mutual_information(wide, names, "__y", names, 10)
            best = scored.orderBy(F.desc("mutual_info"), "feature").limit(k).collect()
            alive = sorted(int(r["feature"][1:]) for r in best)
        else:
            # the F statistic grows with the squared correlation, so that decides
            array, strength = vector_to_array("features"), {}
            wide = ready.select(F.col(label).cast("double").alias("__y"), *[array[i].alias(f"s{i}") for i in alive])
            for start in range(0, len(alive), CORRELATIONS):
                part = alive[start:start + CORRELATIONS]
                row = wide.agg(*[F.corr(f"s{i}", "__y").alias(f"s{i}") for i in part]).first()
                strength |= {i: (row[f"s{i}"] or 0.0) ** 2 for i in part}
            alive = sorted(sorted(alive, key=lambda i: (-strength[i], i))[:k])
    if len(alive) == len(p.slots):
        return p
    stages = [*p.model.stages[:-1], p.model.stages[-1].copy().setOutputCol("__all"),
              VectorSlicer(inputCol="__all", outputCol="features", indices=alive)]
    return Preprocessor(PipelineModel(stages), [p.slots[i] for i in alive], p.target, p.encoding)


def efficient_preprocessing(df: DataFrame, target: str, key: str, *, max_categories: int = 20,
                            max_dummy_features: int = 1000, feature_selection: bool = True,
                            max_features: int = 100, encoding: str = "auto", classification: bool = True,
                            label: str = "label", classes: int | None = None) -> Preprocessor:
    """Preprocessing for wide tables and columns of many values, with selection on top."""
    drop = [c for c in (key,) if c in df.columns]
    p = build_preprocessor(df.drop(*drop), target, max_categories=max_categories,
                           max_dummy_features=max_dummy_features, encoding=encoding, label=label, classes=classes)
    if feature_selection and len(p.slots) > max_features:
        p = select_features(p, df, key, max_features, classification, label)
    return p
