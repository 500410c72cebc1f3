"""Whitened embeddings against numpy, and the eigenvalue solver by itself."""

import math

import numpy as np
import pytest

from tabloom.llm import whitening
from tabloom.llm.queries import QUERIES
from tabloom.llm.whitening import _deviations, leading_eigenpairs, minres, whitened_vectors

SCHEMA = "vec_id bigint, embedding array<float>, n int, x string, data string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "d") for i, v in rows], SCHEMA).repartition(3)


def check(got, rows, wanted):
    """Compares with a dense solution; columns may have either sign."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = ((x * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(wanted, int((values > 1e-12 * values[0]).sum()))
    deviation = {i: int(d) for (i, _), d in zip(rows, ((x * n - sums) ** 2).sum(axis=1))}
    whole = {i: w for (i, _), w in zip(rows, centred @ vectors[:, :k] / np.sqrt(values[:k]))}
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    signs = {}
    for r in got:
        own = whole[r.vec_id][r.component - 1]
        if abs(own) > 0.01:
            signs.setdefault(r.component, np.sign(own * r.whitened))
    for r in got:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and r.identity_error <= 1e-9
        assert abs(r.whitened * signs[r.component] - whole[r.vec_id][r.component - 1]) < 1e-7
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)


@pytest.mark.parametrize("wanted", [3, 32])
def test_components(spark, wanted):
    rng = np.random.default_rng(5)
    shape = rng.standard_normal((10, 10)) * np.linspace(3, 0.3, 10)
    rows = [(k, (rng.standard_normal(10) @ shape).astype(np.float32).tolist()) for k in range(200)]
    bad = [(900, None), (901, [None] + [0.0] * 9), (902, [float("nan")] * 10), (903, [float("-inf")] + [0.0] * 9), (904, []),
           (905, [1.0] * 9), (906, [3e38] * 10)]
    check(whitened_vectors(frame(spark, rows + bad), wanted).collect(), rows, wanted)


def test_no_variance_in_a_direction(spark):
    rows = [(k, [float(k % 7), float(k % 5), 2.5, float(k % 7)]) for k in range(50)]
    check(whitened_vectors(frame(spark, rows)).collect(), rows, 32)


def test_degenerate(spark):
    assert whitened_vectors(frame(spark, [])).count() == 0
    assert whitened_vectors(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitened_vectors(frame(spark, [(1, [1.0, 2.0])] * 3)).count() == 0
    got = whitened_vectors(frame(spark, [(None, [0.0]), (1, [1.0]), (1, [1.0]), (2, [2.0])]))
    assert sorted((r.vec_id is None, round(abs(r.whitened), 6)) for r in got.collect()) == [
        (False, 0.0), (False, 0.0), (False, 1.414214), (True, 1.414214)]


def test_large_deviations():
    x = np.array([[0, 1], [1 << 40, 5]], dtype=np.int64)
    n, sums = 10 ** 9, np.array([10 ** 9 * 7 + 3, 12], dtype=np.int64)
    assert _deviations(x, n, sums) == [sum((int(v) * n - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()
            if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(QUERIES["op13_whitening"](spark, folder).collect(), rows, 32)


@pytest.mark.parametrize("size, values", [(200, 0.97 ** np.arange(200)), (120, np.repeat([5.0, 3.0, 1.0], 40)),
                                          (90, np.r_[1e6, np.ones(89)]), (60, np.r_[np.ones(3), np.zeros(57)])])
def test_eigenpairs(size, values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((size, size)))[0]
    a = (q * values) @ q.T
    widths = []
    found, vectors = leading_eigenpairs(lambda v: (widths.append(v.shape[1]), a @ v)[1], size, 20)
    assert np.allclose(found, np.sort(values)[::-1][:20], rtol=0, atol=1e-12 * values.max())
    assert np.linalg.norm(a @ vectors - vectors * found, axis=0).max() <= 1e-12 * values.max()
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12 and max(widths) <= 20 + whitening.SPARE


def test_minres_solves_the_correction():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = (q * np.arange(1, 31)) @ q.T
    found = q[:, -2:]
    right = rng.standard_normal((30, 2))
    right -= found @ (found.T @ right)
    shifts = np.array([30.0, 29.0])
    t = minres(lambda v: a @ v, shifts, found, right, 40)
    inside = lambda x: x - found @ (found.T @ x)
    assert np.linalg.norm(inside(a @ t - t * shifts) - right) < 1e-8 and np.abs(found.T @ t).max() < 1e-12
