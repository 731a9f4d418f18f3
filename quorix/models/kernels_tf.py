"""Three-way factorization solver of one block, in numpy: sum over k of a_ik b_jk c_lk."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Order in which the dimensions are updated for each factor.
ORDER = (1, 0, 2)


def product(coords: np.ndarray, factors: Sequence[np.ndarray], k: int, without: int | None = None) -> np.ndarray:
    out = np.ones(len(coords))
    for d, f in enumerate(factors):
        if d != without:
            out = out * f[coords[:, d], k]
    return out


def residual(coords: np.ndarray, values: np.ndarray, factors: Sequence[np.ndarray]) -> np.ndarray:
    p = np.ones((len(coords), factors[0].shape[1]))
    for d, f in enumerate(factors):
        p *= f[coords[:, d]]
    return values - p.sum(1)


def solve_block(
    coords: np.ndarray,
    values: np.ndarray,
    factors: Sequence[np.ndarray],
    priors: Sequence[np.ndarray],
    gammas: Sequence[np.ndarray],
    rounds: int,
    *,
    vb: bool = False,
    precs: Sequence[np.ndarray] | None = None,
    frozen: Sequence[bool] = (False, False, False),
    em_bayes: bool = False,
) -> dict[str, object]:
    """CCD++ over the factors; a frozen dimension is skipped by its flag. VB denominators are
    prod (g^2 + 1/prec) over the other dimensions."""
    factors = [f.copy() for f in factors]
    gammas = [np.array(g, float) for g in gammas]
    precs = [np.full(f.shape, np.inf) for f in factors] if precs is None else [p.copy() for p in precs]
    res = residual(coords, values, factors)
    for _ in range(rounds):
        for k in range(factors[0].shape[1]):
            res = res + product(coords, factors, k)
            for d in ORDER:
                if frozen[d]:
                    continue
                own, n = coords[:, d], len(factors[d])
                g = product(coords, factors, k, d)
                if vb:
                    sq = np.ones(len(coords))
                    for o, f in enumerate(factors):
                        if o != d:
                            sq *= f[coords[:, o], k] ** 2 + 1 / precs[o][coords[:, o], k]
                else:
                    sq = g * g
                den = np.bincount(own, sq, n) + gammas[d][k]
                num = np.bincount(own, res * g, n) + gammas[d][k] * priors[d][:, k]
                factors[d][:, k] = np.divide(num, den, out=np.zeros(n), where=den > 0)
                if vb:
                    precs[d][:, k] = np.maximum(den, 1e-12)
            res = res - product(coords, factors, k)
        if em_bayes:
            for d, f in enumerate(factors):
                if not frozen[d]:
                    sq = (f - priors[d]) ** 2 + (1 / precs[d] if vb else 0.0)
                    gammas[d] = max(len(f) - 0.99, 0.01) / (sq.sum(0) + 0.01)
    return {"factors": factors, "precs": precs, "gammas": gammas, "se": float(res @ res)}


def markov_sweep(stats: np.ndarray, weights: np.ndarray, lam: float, start: np.ndarray | None = None) -> np.ndarray:
    """Forward Gauss-Seidel sweep over time: f_n = (lam (f_{n-1} + f_{n+1}) + stats_n) / (2 lam + weights_n),
    with one neighbour at either end. `stats` = sum gamma f and `weights` = sum gamma, shape (T, K)."""
    f = np.zeros_like(stats, dtype=float) if start is None else np.array(start, float)
    last = len(stats) - 1
    for n in range(last + 1):
        near, count = np.zeros(stats.shape[1]), 0
        if n:
            near, count = near + f[n - 1], count + 1
        if n < last:
            near, count = near + f[n + 1], count + 1
        f[n] = (lam * near + stats[n]) / (count * lam + weights[n])
    return f
