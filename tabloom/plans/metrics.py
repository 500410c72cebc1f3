"""Measures of fitted models, from counts that aggregate before they are shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.scalars import named, number, safe_ratio


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(named(label).alias("label"), named(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from confusion counts."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    tall = counts.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")))).alias("e")).select("e.*")
    sums = tall.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision, recall = _share(F.col("hits"), F.col("predicted")), _share(F.col("hits"), F.col("support"))
    scored = sums.select("class", precision.alias("precision"), recall.alias("recall"), "support")
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    return scored.withColumn("f1", f1).select("class", "precision", "recall", "f1", "support")


def summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted means of a class report."""
    total = F.sum("support")

    def weighted(c):
        return F.sum(F.col(c) * F.col("support")) / total
    return report.agg(weighted("recall").alias("accuracy"),
                      *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
                      *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def binary_auc(df: DataFrame, label: Column, score: Column) -> float:
    """Area under the ROC curve over all distinct scores."""
    pair = df.select(label.cast("double").alias("label"), score.cast("double").alias("score"))
    return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0).evaluate(pair)


def auc(df: DataFrame, classes: int, label: str = "label", probability: str = "probability") -> float:
    """Binary area under the curve, or its plain mean over one class against the rest."""
    p = vector_to_array(probability)
    if classes == 2:
        return binary_auc(df, named(label), p[1])
    return sum(binary_auc(df, named(label) == i, p[i]) for i in range(classes)) / classes


def r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One minus the residual over the total sum of squares."""
    y, p = number(label), number(prediction)
    return df.agg((F.lit(1.0) - safe_ratio(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"))


def evaluate(df: DataFrame, classes: int, imbalanced: bool, label: str = "label",
             prediction: str = "prediction") -> dict:
    """Accuracy, F1 (of class 1 when there are two, else weighted), AUC and the class report."""
    counts = confusion(df, label, prediction)
    rows = [r.asDict() for r in class_report(counts).orderBy("class").collect()]
    support = sum(r["support"] for r in rows) or 1
    accuracy = sum(r["recall"] * r["support"] for r in rows) / support
    if classes == 2:
        f1 = next((r["f1"] for r in rows if r["class"] == 1), 0.0)
    else:
        f1 = sum(r["f1"] * r["support"] for r in rows) / support
    area = auc(df, classes, label) if "probability" in df.columns else 0.0
    return {"accuracy": accuracy, "f1": f1, "auc": area, "report": rows,
            "primary": f1 if imbalanced else accuracy}


def report_rows(spark, results: dict[str, dict], labels: Sequence[str]) -> DataFrame:
    """Results of several models as ``(model, metric, class, value)``."""
    rows = []
    for name, m in results.items():
        rows += [(name, k, None, float(m[k])) for k in ("accuracy", "f1", "auc")]
        for r in m["report"]:
            cls = labels[int(r["class"])] if int(r["class"]) < len(labels) else None
            rows += [(name, k, cls, float(r[k])) for k in ("precision", "recall", "f1", "support")]
    return spark.createDataFrame(rows, "model string, metric string, class string, value double")
