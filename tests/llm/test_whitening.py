"""Whitening against numpy's eigenvectors of the whole covariance, and odd rows."""

import numpy as np
import pytest

from partlens.llm import whitening as W

DATA = "/root/testdata/sf0.001"


def dense(c):
    """x, eigenvalues and eigenvectors, falling."""
    x = np.floor(W.SCALE * c) + W.SHIFT
    values, axes = np.linalg.eigh(np.atleast_2d(np.cov(x.T, bias=True)))
    return x, values[::-1], axes[:, ::-1]


def check(out, ids, c, components):
    x, values, axes = dense(c)
    n, mean = len(x), x.mean(0)
    sums = [int(s) for s in x.sum(0)]
    got = {(r.vec_id, r.component): r for r in out.collect()}
    assert len(got) == n * components
    for k in range(components):
        want = (x - mean) @ axes[:, k] / np.sqrt(values[k])
        have = np.array([got[i, k + 1].whitened for i in ids])
        sign = np.sign(have @ want)
        assert np.abs(have * sign - want).max() < 1e-8
        assert abs(got[ids[0], k + 1].explained / (values[k] / values.sum()) - 1) < 1e-9
    for i, row in zip(ids, x, strict=True):
        r = got[i, 1]
        assert r.n == n and r.deviation == sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) and r.identity_error < 1e-9


def test_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [r for r in df.collect() if r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    check(W.op11_whitening(df), [r.vec_id for r in rows], np.array([r.embedding for r in rows], float), 8)


@pytest.mark.parametrize("d", [1, 3, 8])
def test_few_dimensions(spark, d):
    rng = np.random.default_rng(d)
    c = np.round(rng.normal(size=(40, d)) * np.arange(1, d + 1), 3)
    df = spark.createDataFrame([(i, [float(v) for v in row], "x", 5) for i, row in enumerate(c)], "vec_id long, embedding array<double>, x string, component int").repartition(3)
    check(W.op11_whitening(df), list(range(40)), c, d)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [-2.0, 0.25]), (4, [3.0]), (5, [1e30, 0.0])]
    bad = [(6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>")
    out = W.op11_whitening(df).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted([str(g[0]) for g in good] * 2)  # two components each; short vectors end in zeros
    assert {r.n for r in out} == {5} and max(r.deviation for r in out) == 2**63 - 1
    assert W.op11_whitening(df.limit(0)).count() == 0
    assert W.op11_whitening(spark.createDataFrame([(1, [])], df.schema)).count() == 0


def test_no_spread(spark):
    """Equal vectors have no axes; vectors on a line have one."""
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    out = W.op11_whitening(df).collect()
    assert len(out) == 6 and all(r.whitened is None and r.identity_error is None and r.explained == 0 and r.deviation == 0 for r in out)
    df = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    out = W.op11_whitening(df).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in out)


@pytest.mark.parametrize("values", [np.r_[1e6, np.linspace(1, 2, 99)], np.exp(-np.arange(60) / 4.0), np.r_[np.full(40, 5.0), np.ones(30)], 1 + 1e-3 * np.arange(50.0), np.zeros(30)])
def test_eigenvectors_are_certified(values):
    """Spread, tied, crowded and zero spectra; no more passes than the spectrum asks for."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    v = basis * values @ basis.T
    passes = []
    e, q, residual = W.leading(lambda block: passes.append(block.shape) or v @ block, len(v), 8)
    top = np.sort(values)[::-1][:8]
    assert np.allclose(e, top, rtol=1e-12, atol=1e-12 * max(1, values.max()))
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-12 and np.linalg.norm(v @ q - q * e, axis=0).max() <= 1e-10 * max(1, values.max())
    assert len(passes) < 150 and max(p[1] for p in passes) <= 48


def test_a_direction_missing_from_the_start_is_found():
    """The largest eigenvector is orthogonal to the whole start block and all its products."""
    d, k = 40, 8 + W.GUARD
    start = np.linalg.qr(np.random.default_rng(11).normal(size=(d, k)))[0]
    missing = np.linalg.svd(start.T)[2][-1]
    base = np.eye(d) - np.outer(missing, missing)
    v = base @ np.diag(np.linspace(1, 2, d)) @ base + 9 * np.outer(missing, missing)
    v[np.abs(v) < 1e-15] = 0
    e, _, _ = W.leading(lambda block: v @ block, d, 8)
    assert abs(e[0] - 9) < 1e-9
