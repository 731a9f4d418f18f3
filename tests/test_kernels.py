import numpy as np
import pytest

from quorix.models import kernels_lda as L
from quorix.models import kernels_lr as K
from quorix.models import kernels_mf as MF
from quorix.models import kernels_tf as TF
from quorix.models.consensus import initial_factors


def problem(seed=0, n=60, p=6):
    rng = np.random.default_rng(seed)
    dense = rng.normal(size=(n, p)) * (rng.random((n, p)) < 0.7)
    dense[:, 0] = 1
    y = np.where(dense @ rng.normal(size=p) + rng.normal(size=n) > 0, 1.0, -1.0)
    r, c = np.nonzero(dense)
    return K.Design(n, p, r, c, dense[r, c]), dense, y


def penalised(dense, y, w, lam):
    return -np.log1p(np.exp(-y * (dense @ w))).sum() - lam / 2 * (w[1:] @ w[1:])


def test_gradient_and_curvature_by_differences():
    x, dense, y = problem()
    w = np.linspace(-0.3, 0.3, 6)
    f = lambda v: -np.log1p(np.exp(-y * (dense @ v))).sum()
    num = np.array([(f(w + 1e-6 * e) - f(w - 1e-6 * e)) / 2e-6 for e in np.eye(6)])
    assert np.allclose(K.gradient(x, y, w), num, atol=1e-5)
    d = np.ones(6)
    h = (f(w + 1e-4 * d) - 2 * f(w) + f(w - 1e-4 * d)) / 1e-8
    assert np.isclose(K.curvature(x, y, w, d), -h, rtol=1e-3)
    assert np.isclose(K.log_likelihood(x, y, w), f(w))


@pytest.mark.parametrize("method", ["CG", "LBFGS"])
def test_gradient_solvers_reach_the_optimum(method):
    x, dense, y = problem(1)
    w = K.solve_gradient(x, y, np.zeros(6), np.zeros(6), 1.0, 60, method, intercept=0)
    g = dense.T @ (y / (1 + np.exp(y * (dense @ w)))) - np.r_[0, w[1:]]
    assert np.abs(g).max() < 1e-3


@pytest.mark.parametrize("bound", ["JAAKKOLA", "BOHNING", "TAYLOR"])
def test_coordinate_descent_reaches_the_optimum(bound):
    x, dense, y = problem(2)
    w, gamma, _ = K.solve_cd(x, y, np.zeros(6), np.zeros(6), 200, 1.0, 1.0, bound)
    g = dense.T @ (y / (1 + np.exp(y * (dense @ w)))) - w
    assert gamma == 1.0
    # the Jaakkola bound integrates over the posterior, so its optimum is near, not at, the mode
    assert np.abs(g).max() < (2.0 if bound == "JAAKKOLA" else 2e-2)


def test_empirical_bayes_ard_t_prior_and_elastic_net():
    x, dense, y = problem(3)
    w, gamma, gse = K.solve_cd(x, y, np.zeros(6), np.zeros(6), 5, 1.0, 1.0, em_bayes=True)
    assert 0 < gamma < np.inf and gse > 0
    w, gamma, _ = K.solve_cd(x, y, np.zeros(6), np.zeros(6), 5, 1.0, np.ones(6), ard=True)
    assert gamma.shape == (6,) and (gamma > 0).all()
    prior = np.full(6, 0.2)
    pulled, _, _ = K.solve_cd(x, y, np.zeros(6), prior, 50, 1.0, 1.0, l1=1e6)
    assert np.allclose(pulled, prior)
    t = K.solve_t_prior(x, y, np.zeros(6), np.zeros(6), 30, 1.0)
    assert K.log_likelihood(x, y, t) > K.log_likelihood(x, y, np.zeros(6))


def test_global_scalar_minimises():
    rng = np.random.default_rng(5)
    for _ in range(50):
        w, e, g = rng.normal(size=5), rng.random(5) * 2, rng.random(5)
        f = lambda v: (e * np.abs(v - w)).sum() + (g / 2 * (v - w) ** 2).sum() + 0.3 / 2 * v * v  # noqa: B023, E731
        best = K.global_scalar(w, e, g, 0.3)
        grid = np.linspace(-4, 4, 8001)
        assert f(best) <= min(f(v) for v in grid[::20]) + 1e-9 and f(best) <= f(grid[np.argmin([f(v) for v in grid[::40]]) * 40]) + 1e-9


def test_map_and_vb_coordinates():
    one = np.array([0])
    f, _ = MF.coordinate(np.array([2.0]), one, np.array([1.0]), np.zeros(1), np.ones(1), np.zeros(1), None, 1)
    v, _ = MF.coordinate(np.array([2.0]), one, np.array([1.0]), np.zeros(1), np.ones(1), np.zeros(1), np.ones(1), 1)
    assert f[0] == 1.0 and np.isclose(v[0], 2 / 3)


def sequential_cd(rows, cols, vals, fr, fc, gamma):
    """One pass entity by entity, columns then rows."""
    res = vals - (fr[rows] * fc[cols]).sum(1)
    for own, other, f, g in ((cols, rows, fc, fr), (rows, cols, fr, fc)):
        for e in range(len(f)):
            n = np.nonzero(own == e)[0]
            for k in range(f.shape[1]):
                x = g[other[n], k]
                new = ((res[n] + f[e, k] * x) @ x) / (x @ x + gamma)
                res[n] += (f[e, k] - new) * x
                f[e, k] = new
    return fr, fc


def test_vectorised_cd_is_the_sequential_one():
    rng = np.random.default_rng(0)
    rows, cols, vals = rng.integers(0, 6, 40), rng.integers(0, 5, 40), rng.normal(size=40)
    fr, fc = rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    zero = dict(prior_r=np.zeros((6, 3)), prior_c=np.zeros((5, 3)), gamma_r=np.full(3, 0.7), gamma_c=np.full(3, 0.7))
    got = MF.solve_block(rows, cols, vals, fr, fc, rounds=1, method="CD", **zero)
    a, b = sequential_cd(rows, cols, vals, fr.copy(), fc.copy(), 0.7)
    assert np.allclose(got["fr"], a) and np.allclose(got["fc"], b)
    assert np.isclose(got["se"][0], ((vals - (a[rows] * b[cols]).sum(1)) ** 2).sum())


@pytest.mark.parametrize("vb", [False, True])
@pytest.mark.parametrize("method", ["CD", "CDPP"])
def test_mf_objective_falls(method, vb):
    rng = np.random.default_rng(1)
    rows, cols = rng.integers(0, 20, 200), rng.integers(0, 15, 200)
    vals = (rng.normal(size=(20, 2))[rows] * rng.normal(size=(15, 2))[cols]).sum(1)
    fr, fc = 0.1 * rng.normal(size=(20, 2)), np.zeros((15, 2))
    zero = dict(prior_r=np.zeros((20, 2)), prior_c=np.zeros((15, 2)), gamma_r=np.full(2, 0.1), gamma_c=np.full(2, 0.1))
    errors = [MF.solve_block(rows, cols, vals, fr, fc, rounds=r, method=method, vb=vb, **zero)["se"][0] for r in (1, 5, 20)]
    assert errors[0] > errors[1] > errors[2]


def test_ridge_solve():
    rng = np.random.default_rng(2)
    own, g, v = rng.integers(0, 4, 30), rng.normal(size=(30, 3)), rng.normal(size=30)
    f = MF.ridge_solve(own, g, v, 4, 0.5, True)
    for e in range(4):
        x = g[own == e]
        assert np.allclose(f[e], np.linalg.solve(x.T @ x + 0.5 * len(x) * np.eye(3), x.T @ v[own == e]))


@pytest.mark.parametrize("vb", [False, True])
def test_tensor_error_falls_and_frozen_stays(vb):
    rng = np.random.default_rng(3)
    coords = np.stack([rng.integers(0, n, 300) for n in (8, 7, 4)], 1)
    truth = [rng.normal(size=(n, 2)) for n in (8, 7, 4)]
    vals = np.prod([f[coords[:, d]] for d, f in enumerate(truth)], 0).sum(1)
    start = [initial_factors(np.arange(n), d, 2, 3, 0) for d, n in enumerate((8, 7, 4))]
    priors, gammas = [np.zeros(f.shape) for f in start], [np.full(2, 0.1)] * 3
    errors = [TF.solve_block(coords, vals, start, priors, gammas, r, vb=vb)["se"] for r in (1, 4, 12)]
    assert errors[0] >= errors[1] >= errors[2]
    got = TF.solve_block(coords, vals, start, priors, gammas, 3, frozen=(False, False, True))
    assert np.array_equal(got["factors"][2], start[2])


def test_markov_sweep():
    f = TF.markov_sweep(np.array([[1.0], [0.0], [0.0]]), np.ones((3, 1)), 1.0)
    assert np.allclose(f.ravel(), [1 / 2, 1 / 6, 1 / 12])


def test_lda_log_space_agrees_and_bound_rises():
    rng = np.random.default_rng(4)
    docs = [(np.sort(rng.choice(12, 5, replace=False)), rng.integers(1, 5, 5).astype(float)) for _ in range(20)]
    eta = rng.gamma(10, 0.1, (3, 12))
    alpha = np.ones(3)
    a = L.fit_local(docs, eta, 0.1, alpha, 2, 20)
    b = L.fit_local(docs, eta, 0.1, alpha, 2, 20, log_space=True)
    assert np.allclose(a[0], b[0], rtol=0.05)

    def bound(e, gammas):
        from quorix.functions.special import dirichlet_expectation

        lb = dirichlet_expectation(e)
        return sum(L.document_bound(w, c, g, alpha, lb[:, w]) for (w, c), g in zip(docs, gammas)) + L.topic_bound(e, 0.1)

    scores = []
    for rounds in (1, 3, 8):
        e, gammas, _ = L.fit_local(docs, eta, 0.1, alpha, rounds, 100)
        scores.append(bound(e, gammas))
    assert scores[0] < scores[1] < scores[2]


def test_newton_alpha_recovers():
    rng = np.random.default_rng(6)
    theta = rng.dirichlet([0.5, 1.0, 3.0], 4000)
    got = L.newton_alpha_from(np.ones(3), np.log(np.maximum(theta, 1e-300)).sum(0), 4000, 100)
    assert np.allclose(got, [0.5, 1.0, 3.0], rtol=0.15)
    same = L.newton_alpha_scalar(1.0, np.log(np.maximum(rng.dirichlet([0.7] * 3, 4000), 1e-300)).sum(), 4000, 3)
    assert np.isclose(same, 0.7, rtol=0.1)
