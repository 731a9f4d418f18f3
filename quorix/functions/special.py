"""Special functions on numpy arrays (there is no SciPy here)."""

from __future__ import annotations

import math

import numpy as np

# Bernoulli numbers B2..B14 of the asymptotic expansions.
_BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
_SHIFT = 6.0


def _lifted(x: np.ndarray, term):  # noqa: ANN001, ANN202
    """Raise arguments above _SHIFT; returns them and the sum of term(x) over the steps."""
    x = np.array(x, np.float64, copy=True)
    total = np.zeros_like(x)
    while (low := x < _SHIFT).any():
        total[low] += term(x[low])
        x[low] += 1
    return x, total


def digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0, by recurrence and asymptotic series."""
    x, back = _lifted(np.atleast_1d(x), lambda v: 1 / v)
    s = np.log(x) - 0.5 / x
    for n, b in enumerate(_BERNOULLI, 1):
        s -= b / (2 * n * x ** (2 * n))
    return s - back


def trigamma(x: np.ndarray) -> np.ndarray:
    x, back = _lifted(np.atleast_1d(x), lambda v: 1 / v**2)
    s = 1 / x + 0.5 / x**2
    for n, b in enumerate(_BERNOULLI, 1):
        s += b / x ** (2 * n + 1)
    return s + back


def tetragamma(x: np.ndarray) -> np.ndarray:
    x, back = _lifted(np.atleast_1d(x), lambda v: -2 / v**3)
    s = -1 / x**2 - 1 / x**3
    for n, b in enumerate(_BERNOULLI, 1):
        s -= (2 * n + 1) * b / x ** (2 * n + 2)
    return s + back


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[np.float64])(np.asarray(x, np.float64))


def row_normalise(m: np.ndarray) -> np.ndarray:
    """Rows divided by their sums."""
    return m / m.sum(axis=-1, keepdims=True)


def dirichlet_expectation(a: np.ndarray) -> np.ndarray:
    """E[log theta] under Dirichlet(a), for a vector or for each row of a matrix."""
    a = np.asarray(a, np.float64)
    return digamma(a).reshape(a.shape) - digamma(a.sum(axis=-1, keepdims=True)).reshape(*a.shape[:-1], 1)


def exp_dirichlet_expectation(a: np.ndarray) -> np.ndarray:
    return np.exp(dirichlet_expectation(a))


def log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b))."""
    return np.logaddexp(a, b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function with the clamps 4.5398e-05 below -10 and 1 - 1e-05 above 10."""
    x = np.asarray(x, np.float64)
    inner = 1 / (1 + np.exp(-np.clip(x, -10, 10)))
    return np.where(x < -10, 4.5398e-05, np.where(x > 10, 1 - 1e-05, inner))


def clamped_exp(x: np.ndarray) -> np.ndarray:
    """exp with the clamps 4.54e-5 below -10 and 22026 above 10."""
    x = np.asarray(x, np.float64)
    return np.where(x < -10, 4.54e-5, np.where(x > 10, 22026.0, np.exp(np.clip(x, -10, 10))))
