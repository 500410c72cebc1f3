"""Training a classifier end to end."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalars import named, text_columns
from tabloom.operators.encode import category_index
from tabloom.operators.joins import attach, missing_labels
from tabloom.operators.profile import class_counts
from tabloom.operators.sampling import marked_split, sample_rows, spread_rows, stratified_sample
from tabloom.operators.strata import stratified_folds
from tabloom.operators.screening import leaky_features, screen_features
from tabloom.plans import metrics
from tabloom.plans.models import (DEEP, Ensemble, Search, Shape, advanced_models, create_fresh_model, forest,
                                  importances, of, quick_models, with_probability)
from tabloom.plans.prepare import Preprocessor, efficient_preprocessing, fallback_preprocessor
from tabloom.sources.readers import read_data_flexible
from tabloom.session import written
from tabloom.sources.sinks import class_map, read_record, write_csv, write_record

FOLD = "__fold"
KEY = "__row"


@dataclass
class Trained:
    """A fitted model with all that is needed to use and to judge it."""

    name: str
    model: Transformer | Ensemble
    preprocessor: Preprocessor
    labels: list
    target: str
    score: float
    results: dict[str, dict]
    importance: dict[str, float]
    leaky: list[tuple[str, float]] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    model_type: str = "classification"
    info: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.preprocessor.transform(df))

    def importance_table(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        rows = spark.createDataFrame(list(self.importance.items()), "feature string, importance double")
        ordered = rows.orderBy(F.desc("importance"), "feature")
        return ordered.limit(top) if top else ordered

    def save(self, spark: SparkSession, path: str) -> None:
        """Stages as native pipelines; class map, leakage and training report next to them."""
        members = self.model.members if isinstance(self.model, Ensemble) else [self.model]
        for i, m in enumerate(members):
            PipelineModel([m]).write().overwrite().save(f"{path}/members/{i}")
        self.preprocessor.model.write().overwrite().save(f"{path}/preprocessor")
        ensemble = isinstance(self.model, Ensemble)
        write_record(spark, f"{path}/info", {
            "model": self.name, "model_type": self.model_type, "target_variable": self.target, "score": self.score,
            "labels": self.labels, "columns": self.columns, "preprocessor": self.preprocessor.info(),
            "members": len(members), "ensemble": ensemble, "importance": self.importance,
            "weights": self.model.weights if ensemble else [], "voting": self.model.voting if ensemble else "",
            "leaky": self.leaky, "dropped": self.dropped, **self.info})
        if self.labels:
            write_csv(class_map(spark, [str(v) for v in self.labels]), f"{path}/class_mapping")
        if self.leaky:
            write_csv(spark.createDataFrame(self.leaky, "feature string, score double"), f"{path}/leakage_report")
        if self.model_type == "classification":
            report = metrics.report_rows(spark, self.results, [str(v) for v in self.labels])
            report.write.mode("overwrite").json(f"{path}/training_info")


def load_trained(spark: SparkSession, path: str) -> Trained:
    info = read_record(spark, f"{path}/info")
    members = [PipelineModel.load(f"{path}/members/{i}").stages[0] for i in range(info["members"])]
    model = (Ensemble(members, info["weights"], len(info["labels"]), info["voting"]) if info["ensemble"]
             else members[0])
    p = Preprocessor.load(PipelineModel.load(f"{path}/preprocessor"), info["preprocessor"])
    return Trained(info["model"], model, p, info["labels"], info["target_variable"], info["score"], {},
                   info["importance"], [tuple(x) for x in info["leaky"]], info["dropped"], info["columns"],
                   info["model_type"])


def encode_label(df: DataFrame, target: str) -> tuple[DataFrame, list]:
    """Class numbers in sorted order as ``label``; a missing text class counts as ``None``.

    The model holds its classes by nature, so their names are gathered; rows get theirs by an attached table.
    """
    if target in text_columns(df):
        df = df.withColumn(target, F.coalesce(named(target), F.lit("None")))
    index = category_index(df, target)
    values = [r[0] for r in index.select(named(target)).orderBy(named(target)).collect()]
    table = index.select(named(target), "__rows", F.col("index").cast("double").alias("label"))
    return attach(df, table, target, "__rows"), values


def by_source(preprocessor: Preprocessor, slots: list[float] | None) -> dict[str, float]:
    """Importance of the source columns: the sum over the slots made from each."""
    found: dict[str, float] = {}
    for slot, value in zip(preprocessor.slots, slots or []):
        found[slot.source] = found.get(slot.source, 0.0) + value
    return dict(sorted(found.items(), key=lambda kv: (-kv[1], kv[0])))


def with_row_key(df: DataFrame, key: str | None) -> DataFrame:
    """A key that is the same every time the rows are read: a given column, or a hash of the row."""
    if key:
        return df.withColumn(KEY, named(key).cast("string"))
    return df.withColumn(KEY, F.xxhash64(*[named(c) for c in df.columns]).cast("string"))


def evaluated(model: Transformer | Ensemble, test: DataFrame, classes: int, imbalanced: bool) -> dict:
    """Measures of a model on rows scored once and stored; else each of its jobs takes the whole model to all tasks."""
    scored = with_probability(model.transform(test))
    kept = [c for c in ("label", "prediction", "probability") if c in scored.columns]
    return metrics.evaluate(written(scored.select(*kept), "scored"), classes, imbalanced)


def train_classification(df: DataFrame, target: str, *, key: str | None = None, threshold: float = 0.8,
                         use_f1_for_threshold: bool | None = None, sample_size: int | None = None,
                         stratified_sampling: bool = True, search: Search | None = None,
                         leakage_threshold: float = 0.8, quick_mode: bool = True, models: dict | None = None,
                         drop_leaky: bool = True, screen: bool = False, test_share: float = 0.2) -> Trained:
    """Sample, drop leaking columns, prepare, split, fit the models in turn, keep the best one.

    Models are tried until one reaches ``threshold``. A unique ``key`` column is not a feature.
    """
    started = time.time()
    df, labels = encode_label(with_row_key(df, key), target)
    df = df.where(F.col("label").isNotNull())
    if key and key != target:
        df = df.drop(key)
    if sample_size:
        df = (stratified_sample(df, sample_size, "label", KEY) if stratified_sampling
              else sample_rows(df, sample_size, KEY))
    features = [c for c in df.columns if c not in (target, "label", KEY)]
    leaky: list[tuple[str, float]] = []
    if drop_leaky:
        checked = df.select(*[named(c) for c in [*features, target]])
        leaky = [(r["feature"], r["score"]) for r in leaky_features(checked, target, leakage_threshold).collect()]
        features = [c for c in features if c not in {f for f, _ in leaky}]
    dropped: list[str] = []
    if screen:
        dropped = screen_features(df.select(*[named(c) for c in features], named(target)), target).dropped
        features = [c for c in features if c not in dropped]
    # a hash of few columns is not a key, so equal rows stay on one side of the split
    split = marked_split(df.select(*[named(c) for c in features], "label", KEY), KEY, test_share, "label")
    counts = {int(r["label"]): r["n"] for r in class_counts(df, "label").collect()}
    classes, rows = len(labels), sum(counts.values())
    imbalanced = min(counts.values()) / max(counts.values()) < 0.25
    use_f1 = imbalanced if use_f1_for_threshold is None else use_f1_for_threshold
    weights = {i: rows / (classes * n) if imbalanced else 1.0 for i, n in counts.items()}
    weight = F.element_at(F.create_map(*[F.lit(float(x)) for kv in weights.items() for x in kv]), F.col("label"))
    if search:      # folds by key, so that they are the same whatever the order of the rows
        folded = stratified_folds(split.where(~F.col("__test")), KEY, "label", search.folds, name=FOLD)
        split = folded.unionByName(split.where(F.col("__test")).withColumn(FOLD, F.lit(0)))
    raw = spread_rows(split.withColumn("weight", weight), rows).persist(StorageLevel.MEMORY_AND_DISK)
    train_raw = raw.where(~F.col("__test"))
    bare = train_raw.drop("weight", "__test", FOLD)
    failures: dict[str, str] = {}
    try:
        prep = efficient_preprocessing(bare, "label", KEY, max_categories=10, max_dummy_features=500, classes=len(labels),
                                       max_features=50 if quick_mode else 100)
    except Exception as error:  # an encoder that cannot be fitted leaves the plain preprocessor
        failures["preprocessing"] = f"{type(error).__name__}: {error}"[:500]
        prep = fallback_preprocessor(bare.drop(KEY), "label")
    ready = prep.transform(raw).select("label", "features", "weight", "__test", *([FOLD] if search else [])).persist(
        StorageLevel.MEMORY_AND_DISK)
    train, test = ready.where(~F.col("__test")).drop("__test"), ready.where(F.col("__test")).drop("__test")
    shape = Shape(rows, len(prep.slots), classes, imbalanced)
    chosen = models or (quick_models() if quick_mode else advanced_models(shape))
    results: dict[str, dict] = {}
    best_name, best_model, best_score = None, None, 0.0
    for name, fit in chosen.items():
        try:
            estimator = create_fresh_model(name, shape) if search else None
            model = (search.fit(name, estimator, train, quick_mode, "f1" if imbalanced else "accuracy", fold=FOLD)
                     if search and estimator is not None else fit(train, shape))
            m = evaluated(model, test, classes, imbalanced)
        except Exception as error:  # one failing model must not end the comparison
            failures[name] = f"{type(error).__name__}: {error}"[:500]
            continue
        results[name] = m
        if m["primary"] > best_score or best_model is None:
            best_name, best_model, best_score = name, model, m["primary"]
            if (m["f1"] if use_f1 else m["accuracy"]) >= threshold:
                break
    ready.unpersist()
    raw.unpersist()
    if best_model is None:
        raise RuntimeError(f"no model could be fitted: {failures}")
    return Trained(best_name, best_model, prep, labels, target, best_score, results,
                   by_source(prep, importances(best_model)), leaky, dropped, features,
                   info={"rows": rows, "imbalanced": imbalanced, "seconds": time.time() - started,
                         "sample_size": sample_size, "failures": failures})


def split_gaps(train: DataFrame, test: DataFrame, full: DataFrame, label: str) -> dict[str, list]:
    """Classes absent from the train or the test rows."""
    return {side: [r[label] for r in missing_labels(full, part, label).collect()]
            for side, part in (("train", train), ("test", test))}


def train_classification_model(spark: SparkSession, target_variable: str, path: str, output: str | None = None,
                               **options) -> Trained:
    """Read a file, train, and save the result when an output folder is given."""
    trained = train_classification(read_data_flexible(spark, path), target_variable, **options)
    if output:
        trained.save(spark, output)
    return trained


def predict_categorical(df: DataFrame, trees: int = 100, depth: int = DEEP, key: str | None = None) -> DataFrame:
    """Accuracy of predicting every categorical column from the other ones; a column with one value is no target."""
    texts = text_columns(df)
    rows = []
    for target in texts:
        if len(texts) < 2 or df.select(named(target)).distinct().limit(2).count() < 2:
            continue
        held = df.select(*[named(c) for c in texts], *([named(key)] if key and key not in texts else []))
        t = train_classification(held, target, key=key, drop_leaky=False, threshold=2.0,
                                 models={"RandomForest": of(lambda s: forest(s, trees, depth))})
        rows.append((target, t.results["RandomForest"]["accuracy"], {k: float(v) for k, v in t.importance.items()}))
    return df.sparkSession.createDataFrame(
        rows, "target_variable string, accuracy double, importances map<string, double>")
