"""Factorization solvers of one block, in numpy. Factors have shape (n, K).

Entities of one side are independent given the other side, so each coordinate is updated for all entities
of a side at once with bincount; the result is that of visiting them one after the other.
"""

from __future__ import annotations

import numpy as np


def residual(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, fr: np.ndarray, fc: np.ndarray) -> np.ndarray:
    return values - np.einsum("nk,nk->n", fr[rows], fc[cols])


def coordinate(res: np.ndarray, own: np.ndarray, g: np.ndarray, f_own: np.ndarray, gamma: np.ndarray, prior: np.ndarray, prec_g: np.ndarray | None, n: int, keeps: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(new f, denominator) of one coordinate for all n entities of a side.

    f = (sum (res + f g) g + gamma prior) / (sum g^2 [+ sum 1/prec_g] + gamma). `keeps`: the residual
    contains the coordinate's own term (CD); else it was taken out before (CD++). Entities without
    information (denominator 0) keep 0.
    """
    num = np.bincount(own, (res + f_own[own] * g) * g if keeps else res * g, n) + gamma * prior
    den = np.bincount(own, g * g if prec_g is None else g * g + 1 / prec_g, n) + gamma
    return np.divide(num, den, out=np.zeros(n), where=den > 0), den


def precision(f: np.ndarray, prior: np.ndarray, prec: np.ndarray | None, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """gamma_k = (n - .99) / (sum((f - prior)^2 + 1/prec) + .01); weighted: one value over all factors."""
    sq = (f - prior) ** 2 + (0.0 if prec is None else 1 / prec)
    if weights is not None:
        return np.full(f.shape[1], max(f.size - 0.99, 0.01) / (float((sq * weights[:, None]).sum()) + 0.01))
    return max(n - 0.99, 0.01) / (sq.sum(0) + 0.01)


def solve_block(
    rows: np.ndarray,
    cols: np.ndarray,
    values: np.ndarray,
    fr: np.ndarray,
    fc: np.ndarray,
    *,
    prior_r: np.ndarray,
    prior_c: np.ndarray,
    gamma_r: np.ndarray,
    gamma_c: np.ndarray,
    rounds: int,
    method: str = "CDPP",
    vb: bool = False,
    prec_r: np.ndarray | None = None,
    prec_c: np.ndarray | None = None,
    weighted: bool = False,
    em_bayes: bool = False,
    stop: float = 0.0,
) -> dict[str, np.ndarray]:
    """Columns first, then rows (CD), or factor by factor (CD++), MAP or VB, from factors to factors.

    The residual is rebuilt from the factors at the start, so no state hides in the data.
    """
    fr, fc = fr.copy(), fc.copy()
    n, m, k_all = len(fr), len(fc), fr.shape[1]
    n_r, n_c = np.bincount(rows, minlength=n).astype(float), np.bincount(cols, minlength=m).astype(float)
    prec_r = np.full((n, k_all), np.inf) if prec_r is None else prec_r.copy()
    prec_c = np.full((m, k_all), np.inf) if prec_c is None else prec_c.copy()
    gamma_r, gamma_c = np.array(gamma_r, float), np.array(gamma_c, float)
    res = residual(rows, cols, values, fr, fc)
    before = np.inf

    def side(k: int, columns: bool, keeps: bool) -> None:
        nonlocal res
        own, other = (cols, rows) if columns else (rows, cols)
        f, g_all, prec, prec_o, prior, gamma, size, seen = (fc, fr, prec_c, prec_r, prior_c, gamma_c, m, n_c) if columns else (fr, fc, prec_r, prec_c, prior_r, gamma_r, n, n_r)
        g = g_all[other, k]
        gam = gamma[k] * (seen if weighted else 1.0) * np.ones(size)
        new, den = coordinate(res, own, g, f[:, k], gam, prior[:, k], prec_o[other, k] if vb else None, size, keeps)
        if keeps:
            res = res + (f[own, k] - new[own]) * g
        f[:, k] = new
        if vb:
            prec[:, k] = np.maximum(den, 1e-12)

    for _ in range(rounds):
        if method == "CD":
            for columns in (True, False):
                for k in range(k_all):
                    side(k, columns, True)
        else:
            for k in range(k_all):
                res = res + fr[rows, k] * fc[cols, k]
                side(k, True, False)
                side(k, False, False)
                res = res - fr[rows, k] * fc[cols, k]
        if em_bayes:
            gamma_r = precision(fr, prior_r, prec_r if vb else None, n, n_r if weighted else None)
            gamma_c = precision(fc, prior_c, prec_c if vb else None, m, n_c if weighted else None)
        now = float(res @ res)
        if abs(before - now) <= stop:
            break
        before = now
    return {"fr": fr, "fc": fc, "prec_r": prec_r, "prec_c": prec_c, "gamma_r": gamma_r, "gamma_c": gamma_c, "n_r": n_r, "n_c": n_c, "se": np.array([float(res @ res)])}


def ridge_solve(own: np.ndarray, g: np.ndarray, values: np.ndarray, n: int, lam: float, weighted: bool) -> np.ndarray:
    """ALS half-step for n entities: (X'X + lam [n_e] I) f = X'y. Sorted input isn't needed."""
    k = g.shape[1]
    order = np.argsort(own, kind="stable")
    own, g, values = own[order], g[order], values[order]
    counts = np.bincount(own, minlength=n)
    ptr = np.concatenate([[0], np.cumsum(counts)])
    xtx, xty = np.zeros((n, k, k)), np.zeros((n, k))
    for e in np.nonzero(counts)[0]:
        x = g[ptr[e] : ptr[e + 1]]
        xtx[e], xty[e] = x.T @ x, x.T @ values[ptr[e] : ptr[e + 1]]
    ridge = lam * (np.maximum(counts, 1) if weighted else np.ones(n))
    xtx += ridge[:, None, None] * np.eye(k) + 1e-12 * np.eye(k)
    return np.linalg.solve(xtx, xty[:, :, None])[:, :, 0]
