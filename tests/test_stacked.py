"""All numbers of clusters and starts at once, against numpy, MLlib's measures and cases with a known answer."""

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array

from tabloom.plans import cluster, stacked


def frame(spark, x):
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    return df.select(array_to_vector("x").alias("features")).persist()


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0, 0], [50, 0, 0], [0, 50, 0], [0, 0, 50]], dtype=float)
    return middles, np.vstack([m + rng.normal(0, 1, (60, 3)) for m in middles])


def plain_lloyd(x, centres, iterations=20):
    centres = centres.copy()
    for _ in range(iterations):
        at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
        if not (((new - centres) ** 2).sum(1) > 1e-8).any():
            return new
        centres = new
    return centres


def test_lloyd_of_many_starts(spark, blobs):
    _, x = blobs
    rows = stacked.stacked_rows(frame(spark, x)).persist()
    rng = np.random.default_rng(1)
    starts = [x[rng.choice(len(x), k, replace=False)] for k in (1, 2, 2, 3, 5, 8)] + [np.vstack([x[:2], [[9e3, 9e3, 9e3]]])]
    groups = stacked.lloyd(rows, starts)
    for start, found in zip(starts, groups):
        assert np.allclose(found, plain_lloyd(x, start), atol=1e-9)
    cost = [((x[:, None] - g[None]) ** 2).sum(2).min(1).sum() for g in groups]
    assert np.allclose(stacked.costs(rows, groups), cost)
    for held, group in zip(stacked.measure(rows, groups[1:6]), groups[1:6]):
        model = stacked.as_model(spark, group)
        scored = model.transform(frame(spark, x))
        assert held.silhouette == pytest.approx(ClusteringEvaluator().evaluate(scored), abs=1e-9)
        assert cluster.worst_ratio(group.tolist(), dict(enumerate(held.spread.tolist()))) == pytest.approx(
            cluster.davies_bouldin(scored, "prediction", vector_to_array("features"), group.tolist()))


def test_known_number_of_clusters(spark, blobs, tmp_path):
    middles, x = blobs
    scan = cluster.scan_clusters(frame(spark, x), 8)
    assert {m: scan.best(m) for m in cluster.METHODS} == dict.fromkeys(cluster.METHODS, 4)
    centres = sorted(map(tuple, np.round(scan.models[4].clusterCenters()).tolist()))
    assert np.allclose(centres, sorted(map(tuple, middles.tolist())), atol=1)
    costs = [scan.cost[k] for k in sorted(scan.cost)]
    assert costs == sorted(costs, reverse=True) and costs[0] == pytest.approx(((x - x.mean(0)) ** 2).sum())
    scan.models[4].write().overwrite().save(str(tmp_path / "m"))
    again = type(scan.models[4]).load(str(tmp_path / "m"))
    assert np.allclose(again.clusterCenters(), scan.models[4].clusterCenters()) and again.transform(frame(spark, x)).select("prediction").distinct().count() == 4


def test_few_different_rows(spark):
    x = np.array([[1.0, 2.0]] * 300 + [[3.0, 4.0]] * 2)
    rows = stacked.stacked_rows(frame(spark, x))
    found = stacked.stacked_kmeans(rows, range(2, 5), 3, 1)
    assert {k: sorted(c.centres.tolist()) for k, c in found.items()} == {k: [[1.0, 2.0], [3.0, 4.0]] for k in (2, 3, 4)}
    assert all(c.cost < 1e-9 and c.silhouette == pytest.approx(1) for c in found.values())
    candidates, weights = stacked.seed_candidates(rows, 4, 1)
    assert weights.sum() == 302 and len(candidates) <= 2
    assert stacked.stacked_kmeans(rows.where("false"), range(2, 4), 2, 1) == {}
