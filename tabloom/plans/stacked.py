"""K-means for many numbers of clusters and many starts at the same time: one pass over the rows serves all of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, TOLERANCE = 20, 1e-4       # as MLlib's defaults
ROUNDS = 4                             # of sampling seeds
ROWS = 1024                            # held against all centres at a time


@dataclass
class Clusters:
    """Centres of one number of clusters from one start, with their measures."""

    centres: np.ndarray
    cost: float = 0.0
    silhouette: float = 0.0
    spread: np.ndarray | None = None       # mean distance to the centre, NaN without rows


def stacked_rows(ready: DataFrame, features: str = "features") -> DataFrame:
    """``x`` and a hash of it; what the passes read."""
    return ready.select(vector_to_array(features).alias("x")).withColumn("h", F.xxhash64("x"))


def _batched(work: Callable[[np.ndarray, np.ndarray], np.ndarray], piece: int = ROWS):
    """Task that sums up what ``work`` makes of the rows (numbers, hashes), some at a time, in one flat array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                h = batch["h"].to_numpy()
                for k in range(0, len(x), piece):
                    part = work(x[k:k + piece], h[k:k + piece])
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float64).tobytes()], pa.binary())], ["data"])
    return run


def _summed(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows; of many tasks, groups are added up before they reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch["data"].to_pylist():
                part = np.frombuffer(data)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    parts = rows.select("x", "h").mapInArrow(_batched(work), "data binary")
    tasks = rows.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(isqrt(tasks)).mapInArrow(add, "data binary")
    return np.sum([np.frombuffer(r.data) for r in parts.collect()], axis=0)


def seed_candidates(rows: DataFrame, most: int, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that lie well apart, and how many rows are nearest to each: the start of k-means||.

    Every round takes about ``2 * most`` further rows, with chances that grow with the squared distance to those taken so far.
    Equal rows draw each for themselves, so a frequent one is found, but are one candidate.
    """
    first = rows.orderBy(F.xxhash64("h", F.lit(seed)), "h").limit(1).collect()
    if not first:
        return np.zeros((0, 0)), np.zeros(0)
    taken = np.array([first[0].x], dtype=np.float64)

    def gaps(x, centres):
        return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)

    for turn in range(rounds):
        def cost(x, h, centres=taken):
            return np.array([gaps(x, centres).min(1).sum()])
        total = float(_summed(rows, cost)[0])
        if total <= 0:
            break

        def draw(batches, centres=taken, scale=2 * most / total, salt=np.uint64((seed * 1000 + turn) * 0x9E3779B97F4A7C15 % 2 ** 64)):
            met = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                place = np.arange(met, met + batch.num_rows, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
                met += batch.num_rows
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                mixed = batch["h"].to_numpy().astype(np.uint64) ^ salt ^ place
                mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)
                chance = (mixed ^ mixed >> np.uint64(29)).astype(np.float64) / 2.0 ** 64
                keep = np.concatenate([chance[k:k + 1024] < scale * gaps(x[k:k + 1024], centres).min(1)
                                       for k in range(0, len(x), 1024)])
                yield batch.filter(pa.array(keep)).select(["x"])
        # distinct before they are gathered: a frequent row is one candidate
        new = rows.select("x", "h").mapInArrow(draw, "x array<double>").distinct().collect()
        if new:
            taken = np.vstack([taken, np.array(sorted(r.x for r in new), dtype=np.float64)])

    def nearest(x, h):
        return np.bincount(gaps(x, taken).argmin(1), minlength=len(taken)).astype(np.float64)
    return taken, _summed(rows, nearest)


def spread_seeds(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the weighted candidates by k-means++; fewer if there are fewer different ones."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    gap = ((candidates - candidates[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (gap * weights).sum() > 0:
        chosen.append(int(rng.choice(len(candidates), p=gap * weights / (gap * weights).sum())))
        gap = np.minimum(gap, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def _assigning(groups: Sequence[np.ndarray], finish: Callable):
    """Work on rows that are assigned to the nearest centre of every group; ``finish`` gets squares, places and one-hots."""
    centres = np.vstack(groups)
    lengths = (centres * centres).sum(1)
    edges = np.cumsum([0, *map(len, groups)])

    def work(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        squares = np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + lengths, 0)
        places = np.stack([squares[:, a:b].argmin(1) + a for a, b in zip(edges, edges[1:])], axis=1)
        own = np.zeros_like(squares)
        own[np.arange(len(x))[:, None], places] = 1
        return finish(x, squares, places, own)
    return work


def lloyd(rows: DataFrame, starts: Sequence[np.ndarray], iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """Centres of every start after Lloyd's iterations; each pass moves the centres of all starts still on the move."""
    groups = [np.array(s, dtype=np.float64) for s in starts]
    moving = list(range(len(groups)))
    for _ in range(iterations):
        if not moving:
            break
        held = [groups[k] for k in moving]
        found = _summed(rows, _assigning(held, lambda x, squares, places, own: np.hstack([own.T @ x, own.sum(0)[:, None]]).ravel()))
        found = found.reshape(sum(map(len, held)), -1)
        at, still = 0, []
        for k in moving:
            part = found[at:at + len(groups[k])]
            at += len(groups[k])
            n = part[:, -1:]
            new = np.where(n > 0, part[:, :-1] / np.maximum(n, 1), groups[k])       # a centre without rows stays
            if (((new - groups[k]) ** 2).sum(1) > tolerance ** 2).any():
                still.append(k)
            groups[k] = new
        moving = still
    return groups


def costs(rows: DataFrame, groups: Sequence[np.ndarray]) -> np.ndarray:
    """Sum of the squared distances to the nearest centre, per group of centres."""
    return _summed(rows, _assigning(groups, lambda x, squares, places, own: np.take_along_axis(squares, places, 1).sum(0)))


def measure(rows: DataFrame, groups: Sequence[np.ndarray]) -> list[Clusters]:
    """Cost, spread and silhouette (of squared distances) of every group of centres, in two passes for all of them."""
    def moments(x, squares, places, own):
        return np.hstack([own.T @ x, own.sum(0)[:, None], own.T @ (x * x).sum(1)[:, None],
                          (own * np.sqrt(squares)).sum(0)[:, None], (own * squares).sum(0)[:, None]]).ravel()
    total = sum(map(len, groups))
    found = _summed(rows, _assigning(groups, moments)).reshape(total, -1)
    sums, n, lengths, spread, cost = found[:, :-4], found[:, -4], found[:, -3], found[:, -2], found[:, -1]
    safe = np.maximum(n, 1)
    edges = np.cumsum([0, *map(len, groups)])

    def scores(x, squares, places, own):
        # mean squared distance of a row to the rows of a cluster, from the sums of the cluster
        mean = (x * x).sum(1)[:, None] + lengths / safe - 2 * (x @ (sums / safe[:, None]).T)
        mean[:, n == 0] = np.inf
        out = []
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            here = places[:, k]
            inside = mean[np.arange(len(x)), here] * n[here] / np.maximum(n[here] - 1, 1)
            others = np.where(own[:, a:b] == 1, np.inf, mean[:, a:b]).min(1)
            largest = np.maximum(inside, others)
            ok = (n[here] > 1) & np.isfinite(others) & (largest > 0)
            out.append(np.where(ok, (others - inside) / np.where(ok, largest, 1), 0).sum())
        return np.array(out)
    rows_n = float(n[:edges[1]].sum())
    silhouettes = _summed(rows, _assigning(groups, scores)) / max(rows_n, 1)
    return [Clusters(g, float(cost[a:b].sum()), float(s), np.where(n[a:b] > 0, spread[a:b] / safe[a:b], np.nan))
            for g, a, b, s in zip(groups, edges, edges[1:], silhouettes)]


def stacked_kmeans(rows: DataFrame, numbers: Sequence[int], restarts: int, seed: int) -> dict[int, Clusters]:
    """Per number of clusters the best of ``restarts`` starts by cost. Fewer different rows than clusters give fewer centres."""
    candidates, weights = seed_candidates(rows, max(numbers), seed)
    if not len(candidates):
        return {}
    starts = [(k, spread_seeds(candidates, weights, k, seed * 7919 + k * 1000 + r)) for k in numbers for r in range(restarts)]
    groups = lloyd(rows, [s for _, s in starts])
    best: dict[int, tuple[float, np.ndarray]] = {}
    for (k, _), g, c in zip(starts, groups, costs(rows, groups)):
        if k not in best or c < best[k][0]:
            best[k] = c, g
    return dict(zip(best, measure(rows, [g for _, g in best.values()])))


def as_model(spark: SparkSession, centres: np.ndarray) -> KMeansModel:
    """An MLlib model with these centres, which can be applied and saved like a fitted one."""
    from pyspark.mllib.common import _py2java
    from pyspark.mllib.linalg import Vectors

    jvm = spark.sparkContext._jvm
    held = jvm.org.apache.spark.mllib.clustering.KMeansModel(
        _py2java(spark.sparkContext, [Vectors.dense(c.tolist()) for c in centres]))
    return KMeansModel._from_java(jvm.org.apache.spark.ml.clustering.KMeansModel(f"kmeans_{uuid.uuid4().hex[:12]}", held))
