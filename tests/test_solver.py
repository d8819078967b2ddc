"""Optimality of the penalised regressions, checked on the objective itself."""

import tracemalloc

import numpy as np
import pytest

from foldwise.plans import quasi, solver


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 7))
    x = (x - x.mean(0)) / x.std(0)
    y = (x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=120) > 0.8).astype(int)
    return x, y


def gradient(x, y, beta, c):
    a = np.column_stack([np.ones(len(x)), x])
    return c * (a.T @ (solver.balanced(y) * (solver.sigmoid(a @ beta) - y)))


def test_ridge_with_penalised_intercept(data):
    x, y = data
    c = [1e-4, 1e-2, 1.0, 3.0]
    beta, done, _ = solver.fit_batch(x, y, c, np.zeros(4), True, 1000)
    assert done.all()
    for b, ci in zip(beta, c):
        assert np.allclose(gradient(x, y, b, ci) + b, 0, atol=1e-6)


def test_elastic_net_conditions(data):
    x, y = data
    points = [(c, r) for c in (0.01, 0.1, 1) for r in (0, 0.2, 0.5, 0.95)]
    beta, done, _ = solver.fit_batch(x, y, [p[0] for p in points], [p[1] for p in points], False, 20000)
    assert done.all() and (beta[:, 1:] == 0).any()
    for b, (c, r) in zip(beta, points):
        g = gradient(x, y, b, c)
        assert abs(g[0]) < 1e-6
        smooth = g[1:] + (1 - r) * b[1:]
        zero = b[1:] == 0
        assert (np.abs(smooth[zero]) <= r + 1e-6).all()
        assert np.allclose(smooth[~zero] + r * np.sign(b[1:][~zero]), 0, atol=1e-6)


def test_batch_equals_single(data):
    x, y = data
    beta, _, _ = solver.fit_batch(x, y, [0.1, 1], [0.5, 0.2], False, 20000)
    alone, _, _ = solver.fit_batch(x, y, [1], [0.2], False, 20000)
    assert np.allclose(beta[1], alone[0], atol=1e-8)


def test_quasi_newton_from_sums_reaches_the_same_optimum(data):
    x, y = data
    rng = np.random.default_rng(8)
    x = np.column_stack([x, x[:, 0] + 0.1 * rng.normal(size=len(x))])  # nearly the same feature twice
    points = [(c, r) for c in (1e-4, 0.01, 1, 30) for r in (0, 0.2, 0.95)]
    c, l1 = (np.array([p[j] for p in points]) for j in (0, 1))
    beta, done, passes = solver.fit_batch(x, y, c, l1, False, 20000)
    own = quasi.Batch(c, l1, np.ones((len(c), x.shape[1]), bool), float(len(x)), False)
    a, w, parts = np.column_stack([np.ones(len(x)), x]), solver.balanced(y), np.array_split(np.arange(len(x)), 7)
    while own.open(500).any():
        t = np.flatnonzero(own.open(500))
        flat = np.zeros((len(c), 1 + 2 * a.shape[1]))
        flat[t] = sum(quasi.sums(a[i], y[i].astype(float), w[i], own.trial[t]) for i in parts)
        own.advance(flat[:, 0], flat[:, 1 : 1 + a.shape[1]], flat[:, 1 + a.shape[1] :], 500)
    assert done.all() and own.done.all() and (passes >= 1).all()
    assert np.allclose(beta, own.beta, atol=1e-6) and ((beta == 0) == (own.beta == 0)).all()
    # Regressions of a batch may leave features out; those keep 0 and the others are fitted as if alone.
    some = np.arange(x.shape[1]) < 3
    own = quasi.Batch(np.array([1.0]), np.array([0.0]), some[None], float(len(x)), True)
    while own.open(500).any():
        flat = quasi.sums(a, y.astype(float), w, own.trial)
        own.advance(flat[:, 0], flat[:, 1 : 1 + a.shape[1]], flat[:, 1 + a.shape[1] :], 500)
    alone, _, _ = solver.fit_batch(x[:, :3], y, [1.0], [0.0], True, 1000)
    assert np.allclose(own.beta[0, :4], alone[0], atol=1e-6) and (own.beta[0, 4:] == 0).all()


def test_limit_counts_passes(data):
    x, y = data
    beta, done, passes = solver.fit_batch(x, y, [1.0], [0.5], False, 2)
    assert not done.any() and passes.tolist() == [2]
    own = quasi.Batch(np.array([1.0]), np.array([0.5]), np.ones((1, x.shape[1]), bool), float(len(x)), False)
    a, w = np.column_stack([np.ones(len(x)), x]), solver.balanced(y)
    while own.open(2).any():
        flat = quasi.sums(a, y.astype(float), w, own.trial)
        own.advance(flat[:, 0], flat[:, 1 : 1 + a.shape[1]], flat[:, 1 + a.shape[1] :], 2)
    assert not own.done.any() and own.passes.tolist() == [2]


def test_separable_data_converges():
    x = np.linspace(-1, 1, 30)[:, None]
    y = (x[:, 0] > 0).astype(int)
    beta, done, _ = solver.fit_batch(x, y, [3.0, 30.0], [0.0, 0.95], False, 20000)
    assert done.all() and np.isfinite(beta).all()


def test_auc_columns():
    y = np.array([0, 0, 1, 1])
    p = np.array([[0.1, 0.5], [0.4, 0.5], [0.35, 0.5], [0.8, 0.5]])
    assert solver.auc_columns(y, p).tolist() == [0.75, 0.5]
    assert np.isnan(solver.auc_columns(np.ones(4, int), p)).all()


def test_memory_does_not_grow_with_rows_and_regressions():
    """The grid of a long matrix: rows pass in blocks, and AUROC holds the scores of a few regressions."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40_000, 6))
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    tracemalloc.start()
    beta, done, _ = solver.fit_batch(x, y, np.geomspace(1e-3, 3, 42), np.full(42, 0.2), False, 20000)
    auc = solver.auc_of(x, y, beta)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done.all() and peak < 60e6
    assert np.array_equal(auc, solver.auc_columns(y, solver.probabilities(x, beta)))


def test_sizes_in_one_batch_are_the_separate_fits():
    """Regressions on the first k columns share the passes; a column that one does not use stays zero."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    y = (rng.random(300) < 1 / (1 + np.exp(-x[:, 0] - x[:, 2]))).astype(int)
    c = [1e-3, 0.1, 3.0]
    active = np.arange(4) < np.repeat([1, 2, 4], 3)[:, None]
    beta, done, passes = solver.fit_batch(x, y, np.tile(c, 3), np.zeros(9), True, 1000, active)
    for i, k in enumerate((1, 2, 4)):
        alone, its_done, its_passes = solver.fit_batch(x[:, :k], y, c, np.zeros(3), True, 1000)
        own = slice(3 * i, 3 * i + 3)
        assert np.allclose(beta[own, : k + 1], alone, atol=1e-10) and not beta[own, k + 1 :].any()
        assert (done[own] == its_done).all() and (passes[own] == its_passes).all()


def test_losses_of_large_scores_do_not_overflow():
    rng = np.random.default_rng(9)
    score = rng.normal(size=(3, 50)) * 10
    both = [solver.losses(score.copy(), moderate) for moderate in (True, False)]
    for a, b in zip(*both, strict=True):
        assert np.allclose(a, b, rtol=1e-12, atol=1e-15)
    loss, wrong, bend = solver.losses(np.array([[800.0, -800.0]]), False)
    assert loss[0] == 800 and np.allclose(wrong, [[1, 0]]) and (bend == 1e-10).all()
    x, y = np.array([[-500.0], [1.0], [2.0], [400.0]]), np.array([0, 1, 0, 1])
    beta, done, _ = solver.fit_batch(x, y, [1.0], [0.0], True, 1000)
    assert done.all() and np.isfinite(beta).all()
