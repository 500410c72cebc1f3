"""K-means and the choice of the number of clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.plans.classify import Trained
from tabloom.plans.models import SEED
from tabloom.plans.prepare import build_preprocessor
from tabloom.plans.stacked import as_model, stacked_kmeans, stacked_rows
from tabloom.sources.readers import read_data_flexible

METHODS = ("elbow", "silhouette", "davies_bouldin")


def fit_kmeans(ready: DataFrame, k: int, restarts: int = 10) -> KMeansModel:
    """The best of several starts by training cost."""
    tried = (KMeans(k=k, seed=SEED + i).fit(ready) for i in range(restarts))
    return min(tried, key=lambda m: m.summary.trainingCost)


def one_cluster_cost(ready: DataFrame) -> float:
    """Squared distances to the common mean."""
    m = ready.select(Summarizer.metrics("count", "variance").summary(F.col("features")).alias("m")).first()["m"]
    return float(sum(m["variance"].toArray()) * (m["count"] - 1))


def centre_distance(features: Column, centre: Sequence[float]) -> Column:
    """Plain Euclidean distance of an array column to one centre."""
    fixed = F.array(*[F.lit(float(v)) for v in centre])
    squares = F.zip_with(features, fixed, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda t, x: t + x))


def distances(model: KMeansModel, features: str = "features") -> Column:
    """Array of the distances to all centres."""
    held = vector_to_array(features)
    return F.array(*[centre_distance(held, c) for c in model.clusterCenters()])


def davies_bouldin(df: DataFrame, prediction: str, features: Column, centres: Sequence[Sequence[float]]) -> float:
    """Mean over clusters of the worst (spread + spread) / (centre distance).

    One aggregate gives the spreads; the centres are few.
    """
    measured = df.select(F.col(prediction).alias("c"), F.get(F.array(*[
        centre_distance(features, c) for c in centres]), F.col(prediction)).alias("d"))
    return worst_ratio(centres, {r["c"]: r["s"] for r in measured.groupBy("c").agg(F.avg("d").alias("s")).collect()})


def worst_ratio(centres: Sequence[Sequence[float]], spread: dict[int, float]) -> float:
    """Mean over the clusters that have rows, whose spreads are given, of the worst ratio."""
    used = sorted(spread)
    if len(used) < 2:
        return math.inf
    worst = []
    for i in used:
        ratios = []
        for j in used:
            if i != j:
                gap = math.dist(centres[i], centres[j])
                ratios.append((spread[i] + spread[j]) / gap if gap else math.inf)
        worst.append(max(ratios))
    return sum(worst) / len(worst)


@dataclass
class Scan:
    """Measures of k-means for a range of cluster numbers; one fit per number serves all of them."""

    cost: dict[int, float] = field(default_factory=dict)
    silhouette: dict[int, float] = field(default_factory=dict)
    davies_bouldin: dict[int, float] = field(default_factory=dict)
    models: dict[int, KMeansModel] = field(default_factory=dict)

    def best(self, method: str, elbow_method: str = "acceleration") -> int:
        if method == "silhouette":
            return max(self.silhouette, key=self.silhouette.get)
        if method == "davies_bouldin":
            return min(self.davies_bouldin, key=self.davies_bouldin.get)
        return elbow([self.cost[k] for k in sorted(self.cost)], elbow_method)


def elbow(costs: Sequence[float], method: str = "acceleration") -> int:
    """Number of clusters at the sharpest bend of the cost curve that starts at one cluster."""
    bends = []
    for a, b, c in zip(costs, costs[1:], costs[2:]):
        second = a - 2 * b + c
        bends.append(second if method == "acceleration" else abs(second / math.hypot(2, a - c)))
    if not bends:
        return 2
    return min(max(range(len(bends)), key=lambda i: bends[i]) + 2, len(costs))


def scan_clusters(ready: DataFrame, most: int = 20, methods: Sequence[str] = METHODS, restarts: int = 10) -> Scan:
    """All numbers of clusters from 2 to ``most``, all restarts of each, in the same passes over the rows."""
    found = Scan()
    if "elbow" in methods:
        found.cost[1] = one_cluster_cost(ready)
    rows = stacked_rows(ready).persist(StorageLevel.MEMORY_AND_DISK)
    for k, held in stacked_kmeans(rows, range(2, most + 1), restarts, SEED).items():
        found.models[k] = as_model(ready.sparkSession, held.centres)
        found.cost[k] = held.cost
        if "silhouette" in methods:
            found.silhouette[k] = held.silhouette
        if "davies_bouldin" in methods:
            found.davies_bouldin[k] = worst_ratio(held.centres.tolist(), {
                i: float(s) for i, s in enumerate(held.spread) if s == s})
    rows.unpersist()
    return found


def find_optimal_clusters(ready: DataFrame, max_clusters: int = 20, methods: Sequence[str] = METHODS,
                          restarts: int = 10) -> dict[str, int]:
    scan = scan_clusters(ready, max_clusters, methods, restarts)
    return {m: scan.best(m) for m in methods}


def train_clustering(df: DataFrame, n_clusters: int | None = None, max_clusters_optimal: int = 20,
                     optimal_method: str = "elbow", methods_optimal: Sequence[str] = METHODS,
                     restarts: int = 10) -> Trained:
    """Mean-imputed, scaled and one-hot encoded rows in k clusters; k chosen when not given."""
    prep = build_preprocessor(df, None, impute="mean", encoding="ordinal")
    ready = prep.transform(df).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    results: dict[str, dict] = {}
    if n_clusters is None:
        methods = methods_optimal if optimal_method == "all" else (optimal_method,)
        scan = scan_clusters(ready, max_clusters_optimal, methods, restarts)
        chosen = {m: scan.best(m) for m in methods}
        results["chosen"] = chosen
        n_clusters = chosen.get("elbow") or next(iter(chosen.values()))
        model, cost = scan.models[n_clusters], scan.cost[n_clusters]
    else:
        model = fit_kmeans(ready, n_clusters, restarts)
        cost = float(model.summary.trainingCost)
    ready.unpersist()
    return Trained("KMeans", model, prep, [], "cluster", cost, results, {},
                   columns=df.columns, model_type="clustering", info={"clusters": n_clusters})


def train_clustering_model(spark: SparkSession, path: str, output: str | None = None, **options) -> Trained:
    """Read a file, cluster, and save the result when an output folder is given."""
    trained = train_clustering(read_data_flexible(spark, path), **options)
    if output:
        trained.save(spark, output)
    return trained
