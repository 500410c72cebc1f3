"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson, which only needs products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_arrow, stored

SCALE, SHIFT = 64, 1_000_000       # an entry c becomes floor(SCALE * c) + SHIFT
LARGEST = 1 << 52                  # entries beyond it, scaled, aren't exact in a double
BLOCK_ROWS = 4096                  # vectors of a stored block
SPARE = 8                          # directions that are followed besides the wanted ones
INNER = 6                          # MINRES steps of a correction equation
ROUNDS = 60
PRECISION = 64 * float(np.finfo(np.float64).eps)     # residuals, against the largest eigenvalue
LONG = (1 << 63) - 1
Product = Callable[[np.ndarray], np.ndarray]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Whole-number vectors of each batch as one block of bytes, in pieces of ``BLOCK_ROWS``."""
    for batch in batches:
        vectors = batch["x"]
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            ids = batch["vec_id"].slice(k, BLOCK_ROWS)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(ids)], pa.int64()),
                 pa.array([flat[k:k + BLOCK_ROWS].tobytes()], pa.binary())], ["vec_ids", "n", "data"])


def vector_blocks(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, int]:
    """Vectors as whole numbers in stored blocks (``vec_ids``, ``n``, ``data``), and their length.

    Rows whose vector is null, or holds null or non-finite entries or such that are not exact after scaling, are dropped, as are
    those of another length than most vectors have (the longer of two equally frequent ones) and empty vectors.
    """
    v = F.col("v")
    usable = rows.select(rows[id_column].alias("vec_id"), rows[vector_column].cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST / SCALE)))
    sizes = usable.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    whole = usable.where(F.size(v) == size).select(
        "vec_id", F.transform(v, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT).alias("x"))
    kind = whole.schema["vec_id"].dataType.simpleString()
    blocks = map_arrow(whole, lambda batches: _blocks(batches, size), f"vec_ids array<{kind}>, n bigint, data binary")
    return stored(blocks, "vector-blocks"), size


def _added(parts: DataFrame, kind: type) -> np.ndarray | None:
    """Sum of the byte arrays of all tasks; where there are many tasks, groups of them are added up first."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch["data"].to_pylist():
                array = np.frombuffer(data, dtype=kind)
                total = array.copy() if total is None else total + array
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])

    tasks = parts.rdd.getNumPartitions()
    if tasks > 64:
        parts = map_arrow(parts.repartition(isqrt(tasks)), add, "data binary")
    arrays = [np.frombuffer(r.data, dtype=kind) for r in parts.collect()]
    return sum(arrays[1:], arrays[0].copy()) if arrays else None


def _over_blocks(blocks: DataFrame, size: int, work: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """Sum over all blocks of what ``work`` makes of a block's whole-number vectors."""
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for data in batch["data"].to_pylist():
                part = work(np.frombuffer(data, dtype=np.int64).reshape(-1, size))
                found = part if found is None else found + part
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(found, dtype=kind).tobytes()], pa.binary())], ["data"])

    return _added(map_arrow(blocks.select("data"), total, "data binary"), kind)


def _orthonormal(new: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal directions that the columns of ``new`` add to ``against``; those that add nothing are left out."""
    for _ in range(3):                     # repeated, since one projection leaves rounding errors
        norms = np.linalg.norm(new, axis=0)
        new = new[:, norms > 0] / norms[norms > 0]
        new = new - against @ (against.T @ new)
        left = np.linalg.norm(new, axis=0)
        new = new[:, left > 1e-10]
        if not new.shape[1]:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * s[0]]
    return new


def minres(product: Product, shifts: np.ndarray, found: np.ndarray, right: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions ``t`` of ``(I - QQ')(A - shift I)(I - QQ') t = right``, a column per shift, by MINRES.

    All columns go through their steps together, so a step needs one product of ``A`` with a block. ``Q`` is ``found``.
    """
    def inside(x: np.ndarray) -> np.ndarray:
        return x - found @ (found.T @ x)

    n = right.shape[1]
    solution = np.zeros_like(right)
    v_old, v = np.zeros_like(right), inside(right)
    beta = np.linalg.norm(v, axis=0)
    v = v / np.where(beta > 0, beta, 1)
    eta, c_old, c, s_old, s = beta.copy(), np.ones(n), np.ones(n), np.zeros(n), np.zeros(n)
    w_older, w_old = np.zeros_like(right), np.zeros_like(right)
    beta = np.zeros(n)
    floor = 1e-14 * max(1e-300, float(np.max(np.abs(shifts), initial=0.0)))
    live = eta > 0
    for _ in range(steps):
        if not live.any():
            break
        u = inside(product(v) - v * shifts) - v_old * beta
        alpha = np.sum(v * u, axis=0)
        u = inside(u - v * alpha)
        beta_new = np.linalg.norm(u, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, beta_new)
        rho2 = s * alpha + c_old * c * beta
        rho3 = s_old * beta
        live &= rho1 > floor
        safe = np.where(rho1 > 0, rho1, 1)
        c_new, s_new = delta / safe, beta_new / safe
        w = (v - w_older * rho3 - w_old * rho2) / safe
        solution += np.where(live, c_new * eta, 0) * w
        eta = -s_new * eta
        live &= beta_new > floor
        v_old, v = v, np.where(live, u / np.where(beta_new > 0, beta_new, 1), 0)
        w_older, w_old, beta, c_old, c, s_old, s = w_old, w, beta_new, c, c_new, s, s_new
    return inside(solution)


def leading_eigenpairs(product: Product, size: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and eigenvectors of a positive semidefinite matrix given by its products.

    Jacobi-Davidson for several pairs at once: Rayleigh-Ritz on a subspace gives approximations and residuals; pairs
    whose residual is at double precision are locked; for the others a correction orthogonal to all approximations is
    solved for by a few MINRES steps and extends the subspace, which is cut back to its best directions when it has
    grown to four times their number. Locked pairs stay in the subspace, so that none is passed over.
    """
    wanted = min(wanted, size)
    width = min(size, wanted + SPARE)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((size, width)), np.zeros((size, 0)))
    image = product(basis)
    best = None
    for turn in range(ROUNDS):
        small = basis.T @ image
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(values)[::-1][:width]
        values, inner = values[order], inner[:, order]
        vectors, images = basis @ inner, image @ inner
        norms = np.linalg.norm((images - vectors * values)[:, :wanted], axis=0)
        limit = PRECISION * max(float(values[0]), 0.0)
        if best is None or norms.max() < best[0]:
            best = norms.max(), values[:wanted], vectors[:, :wanted]
        if norms.max() <= limit or basis.shape[1] == size:      # the whole space leaves rounding errors only
            break
        if width < basis.shape[1] and basis.shape[1] + width > 4 * width:
            basis, image = vectors, images              # start again from the best directions
        loose = np.flatnonzero(norms > limit)           # the others are locked
        new = minres(product, values[loose], vectors, -(images - vectors * values)[:, loose], INNER)
        new = _orthonormal(new, basis)
        if not new.shape[1]:                            # the corrections add nothing: go on from other directions
            new = _orthonormal(np.random.default_rng(seed + turn + 1).standard_normal((size, SPARE)), basis)
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    norm, values, vectors = best
    if norm > 1e4 * PRECISION * max(float(values[0]), 0.0) and norm > 0:
        raise ArithmeticError(f"residuals stay at {norm}")
    return values, vectors


@dataclass
class Whitening:
    """Moments and components of the vectors it was fitted on."""

    n: int
    sums: list[int]
    total: int                    # of all squared deviations, times n ** 2
    values: np.ndarray            # eigenvalues, falling
    components: np.ndarray        # one column per component
    identity_error: float


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    # the whole part of the mean is taken off first, so that products with n stay small
    base = sums // n
    return ((x - base) * n - (sums - base * n)) / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over the dimensions of (n x - S) ** 2 for every vector, exact whatever its size."""
    base = sums // n
    rest = (sums - base * n).tolist()
    off = x - base
    if n * (int(np.abs(off).max(initial=0)) + 1) < isqrt(LONG // max(1, x.shape[1])):
        return ((off * n - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((v * n - r) ** 2 for v, r in zip(row, rest)) for row in off.tolist()]


def fit_whitening(blocks: DataFrame, size: int, wanted: int = 32) -> Whitening | None:
    """Moments and components of all vectors in ``blocks``; None without vectors.

    Every product with the covariance is one pass over the stored blocks, of which tasks return sums the size of the
    product; neither a covariance matrix nor vectors are gathered anywhere.
    """
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    # sums of halves of the numbers, so that they can't overflow
    halves = _over_blocks(blocks, size, lambda x: np.concatenate([(x >> 20).sum(axis=0), (x & (1 << 20) - 1).sum(axis=0)]), np.int64)
    sums = [(int(h) << 20) + int(low) for h, low in zip(halves[:size], halves[size:])]
    held = np.array(sums, dtype=np.int64)

    def spread(x: np.ndarray) -> np.ndarray:
        total = sum(_deviations(x, n, held))
        return np.array([total >> 32 * k & (1 << 32) - 1 for k in range(8)], dtype=np.int64)

    total = sum(int(v) << 32 * k for k, v in enumerate(_over_blocks(blocks, size, spread, np.int64)))
    if not total:
        return Whitening(n, sums, 0, np.zeros(0), np.zeros((size, 0)), 0.0)

    def product(vectors: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, held)
            return y.T @ (y @ vectors)
        return _over_blocks(blocks, size, part, np.float64).reshape(size, -1) / n

    values, components = leading_eigenpairs(product, size, wanted)
    real = values > size * np.finfo(np.float64).eps * values[0] * 4     # a null direction can't be scaled to one
    values, components = values[real], components[:, real]
    scaled = components / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, held) @ scaled
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _over_blocks(blocks, size, moments, np.float64) / n
    k = len(values)
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    return Whitening(n, sums, total, values, components, float(np.abs(covariance - np.eye(k)).max(initial=0.0)))


def whitened_vectors(rows: DataFrame, wanted: int = 32, id_column: str = "vec_id",
                     vector_column: str = "embedding") -> DataFrame:
    """Every usable vector on the whitened leading components, long form: one row per vector and component.

    Columns: ``vec_id``, ``component`` (from 1, by falling eigenvalue), ``n`` (vectors fitted on), ``deviation`` (sum over
    dimensions of (n x - S) ** 2), ``whitened``, ``explained`` (share of the variance) and ``identity_error`` (largest entry
    of the whitened covariance less the identity).

    Which vectors are dropped says ``vector_blocks``. Fewer components are returned where there are fewer dimensions or
    where the variance in further directions is zero (none if all vectors are equal, so an empty result then). A
    ``deviation`` that no long can hold is NULL. NULL ids and repeated rows stay as they are and count each. An empty
    table gives an empty result.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    blocks, size = vector_blocks(rows, id_column, vector_column)
    fit = fit_whitening(blocks, size, wanted) if size else None
    if fit is None or not len(fit.values):
        return rows.sparkSession.createDataFrame([], schema)
    scaled, held, n, error = fit.components / np.sqrt(fit.values), np.array(fit.sums, dtype=np.int64), fit.n, fit.identity_error
    explained = fit.values * (float(n) ** 3 / fit.total)      # the trace is total / n ** 3
    k = len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x = np.frombuffer(batch["data"][at].as_py(), dtype=np.int64).reshape(-1, size)
                places = pa.array(np.repeat(np.arange(len(x)), k))
                deviations = [d if d <= LONG else None for d in _deviations(x, n, held)]
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_ids"][at].values.take(places), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, n)), pa.array(deviations, pa.int64()).take(places),
                     pa.array((_centred(x, n, held) @ scaled).ravel()), pa.array(np.tile(explained, len(x))),
                     pa.array(np.full(len(x) * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return map_arrow(blocks, project, schema)
