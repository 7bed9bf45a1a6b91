"""Whitening against a dense eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from papertide.llm import whitening

ROWS = "vec_id long, embedding array<float>, n int, x string"


def brute(rows):
    sound = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not sound:
        return {}
    fit = np.array(sorted({tuple(x) for _, x in sound}), dtype=np.float64)
    n, sums = len(fit), [sum(c) for c in zip(*{tuple(x) for _, x in sound}, strict=True)]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in sound:
        z = (np.array(x) - np.array(sums) / n) @ vectors[:, ::-1][:, :4]
        out.append((i, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), z, values[::-1][:4], values.sum()))
    return out


def check(spark, rows):
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS).repartition(3)
    got, want = {}, brute(rows)
    for r in whitening.whitened(table).collect():
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    k = min(4, sum(want[0][4] > 1e-9 * want[0][5]))
    assert sum(map(len, got.values())) == len(want) * k
    signs = None
    for i, n, deviation, z, values, trace in want:
        mine = sorted({r.component: r for r in got[(i, deviation)]}.items())
        assert [c for c, _ in mine] == list(range(1, k + 1)) and all(r.n == n and r.identity_error <= 1e-9 for _, r in mine)
        mine = [r for _, r in mine]
        expected = z[:k] / np.sqrt(values[:k])
        if signs is None and np.abs(expected).min() > 0.01:
            signs = np.sign(expected * [r.whitened for r in mine])
        if signs is not None:
            assert np.allclose([r.whitened for r in mine], signs * expected, atol=1e-8)
        assert np.allclose([r.explained for r in mine], values[:k] / trace, rtol=1e-9)


@pytest.mark.parametrize("d", [2, 5, 40])
def test_mixtures(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((200, d)) * np.linspace(1.0, 0.2, d)).astype(np.float32).tolist()
    check(spark, [(i, v) for i, v in enumerate(vectors)] + [(500, vectors[0])] * 30)


def test_odd_rows(spark):
    odd = [(1, None), (2, [None, 1.0, 2.0]), (3, [float("nan"), 1.0, 2.0]), (4, [float("inf"), 0.0, 0.0]), (5, [])]
    flat = [(10 + i, [float(i), 2.0 * i, 1.0]) for i in range(5)]  # one direction varies
    check(spark, odd + flat + [(None, [1.0, 2.0, 1.0])])
    run = lambda rows: whitening.whitened(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], ROWS)).collect()
    assert run([]) == [] and run(odd) == [] and run([(1, [1.0, 2.0])] * 3) == []
    assert {r.vec_id for r in run(flat + [(99, [1.0])])} == {i for i, _ in flat}


def test_lanczos_finds_multiple_eigenvalues():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((60, 60)))
    spectrum = np.array([9.0] * 12 + [5.0] * 10 + list(np.linspace(1, 0, 38)))
    matrix = q @ np.diag(spectrum) @ q.T
    values, vectors, _ = whitening.block_lanczos(lambda b: matrix @ b, 60, wanted=14, width=4)
    assert np.allclose(values, spectrum[:14]) and np.allclose(matrix @ vectors, vectors * values) and np.allclose(vectors.T @ vectors, np.eye(14))


def test_lanczos_stops_early_and_restarts():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((400, 400)))
    matrix = q @ np.diag(np.append([90.0, 70.0, 50.0, 30.0, 10.0], np.full(395, 1e-3))) @ q.T
    values, _, passes = whitening.block_lanczos(lambda b: matrix @ b, 400)
    assert np.allclose(values, [90, 70, 50, 30]) and passes < 12
    low = np.zeros((30, 30))
    low[0, 0] = 2.0
    assert np.allclose(whitening.block_lanczos(lambda b: low @ b, 30)[0], [2, 0, 0, 0])
