"""Logistic regression solvers of one block, in numpy. Labels are -1/+1, column 0 may be the intercept.

X is given as coordinates (rows, cols, vals) of an n x p matrix, sorted by column; `intercept` is the
local position of feature 0, or -1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from quorix.functions.special import sigmoid

MIN_CURVATURE = 1e-5
#: Pseudo counts of the precision of a block.
PSEUDO = 0.005


@dataclass
class Design:
    """One block's matrix, with the slices of its columns."""

    n: int
    p: int
    rows: np.ndarray
    cols: np.ndarray
    vals: np.ndarray
    ptr: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.rows, self.cols))
        self.rows, self.cols, self.vals = self.rows[order], self.cols[order], np.asarray(self.vals, np.float64)[order]
        self.ptr = np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.p))]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * w[self.cols], self.n)

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.vals * r[self.rows], self.p)


def log_likelihood(x: Design, y: np.ndarray, w: np.ndarray) -> float:
    m = y * x.times(w)
    return float(np.where(m > -10, -np.log1p(np.exp(-np.maximum(m, -10))), m).sum())


def gradient(x: Design, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.transposed_times(y * (1 - sigmoid(y * x.times(w))))


def curvature(x: Design, y: np.ndarray, w: np.ndarray, d: np.ndarray) -> float:
    s = sigmoid(y * x.times(w))
    return float((np.maximum(s * (1 - s), MIN_CURVATURE) * x.times(d) ** 2).sum())


def conjugate_direction(g: np.ndarray, last_g: np.ndarray, d: np.ndarray, clip: float | None = None) -> np.ndarray:
    """Hestenes-Stiefel, its factor within +-`clip`; falls back on the gradient where the denominator vanishes."""
    dg = g - last_g
    den = d @ dg
    if abs(den) < 1e-300:
        return g.copy()
    beta = (g @ dg) / den
    return g - d * (beta if clip is None else min(max(beta, -clip), clip))


def quasi_newton_direction(g: np.ndarray, last_g: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Memoryless BFGS with the last pair of step and gradient change."""
    dg = g - last_g
    sy = step @ dg
    if abs(sy) < 1e-300:
        return g.copy()
    b = 1 + (dg @ dg) / sy
    a_g = (step @ g) / sy
    a_w = (dg @ g) / sy - b * a_g
    return -g + a_w * step + a_g * dg


def objective(x: Design, y: np.ndarray, w: np.ndarray, prior: np.ndarray, shrink: np.ndarray | float, l1: float = 0.0) -> float:
    """Penalised log-likelihood of a block: minus shrink/2 (w - prior)^2 and, elastic, l1 |w - prior|."""
    d = w - prior
    return log_likelihood(x, y, w) - float((np.asarray(shrink) / 2 * d * d).sum()) - l1 * float(np.abs(d).sum())


def solve_gradient(
    x: Design, y: np.ndarray, w: np.ndarray, prior: np.ndarray, lam: float, rounds: int, method: str, intercept: int = -1, clip: float | None = None, stop: float = 0.0
) -> np.ndarray:
    """CG or one-pair quasi-Newton ascent to the penalised optimum around `prior`, with exact Newton step
    length along the direction. The first two rounds are steepest ascent; the intercept isn't shrunk.
    `clip` bounds the conjugate factor; `stop` ends once the objective changes by no more than it."""
    shrink = np.full(x.p, lam)
    if intercept >= 0:
        shrink[intercept] = 0.0
    w = w.astype(np.float64).copy()
    last_g, d, step, last = None, None, None, None
    for t in range(rounds):
        if stop > 0:
            now = objective(x, y, w, prior, shrink)
            if last is not None and abs(now - last) <= stop:
                break
            last = now
        g = gradient(x, y, w) - shrink * (w - prior)
        if t < 2:
            d = g
        elif method == "CG":
            d = conjugate_direction(g, last_g, d, clip)
        else:
            d = quasi_newton_direction(g, last_g, step)
        den = float(shrink @ d**2) + curvature(x, y, w, d)
        if den <= 0 or not np.isfinite(den):
            break
        step = d * ((g @ d) / den)
        w += step
        last_g = g
    return w


def bound_terms(x: Design, y: np.ndarray, w: np.ndarray, bound: str, precision: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, residual) of the quadratic bound at w, residual = working target minus a times the score.

    JAAKKOLA uses xi = sqrt((w.x)^2 + sum x^2 / precision) and a = (sigmoid(xi) - 1/2) / xi (1/4 below 1e-3).
    """
    score = x.times(w)
    s = sigmoid(score)
    target = (y + 1) / 2
    if bound == "BOHNING":
        return np.full(x.n, 0.25), target - s
    if bound == "TAYLOR":
        return np.maximum(s - s * s, MIN_CURVATURE), target - s
    spread = np.bincount(x.rows, x.vals**2 / precision[x.cols], x.n) if precision is not None else 0.0
    xi = np.sqrt(score**2 + spread)
    a = np.where(xi < 1e-3, 0.25, (sigmoid(xi) - 0.5) / np.maximum(xi, 1e-300))
    return a, y / 2 - a * score


def bound_objective(x: Design, y: np.ndarray, w: np.ndarray, bound: str, precision: np.ndarray | None = None) -> float:
    """The log-likelihood's lower bound at its own expansion point: below it for JAAKKOLA with a spread, else equal to it."""
    if bound != "JAAKKOLA":
        return log_likelihood(x, y, w)
    score = x.times(w)
    spread = np.bincount(x.rows, x.vals**2 / precision[x.cols], x.n) if precision is not None else 0.0
    xi = np.sqrt(score**2 + spread)
    return float((-np.log1p(np.exp(-xi)) + (y * score - xi) / 2).sum())


def solve_cd(
    x: Design,
    y: np.ndarray,
    w: np.ndarray,
    prior: np.ndarray,
    rounds: int,
    rho: float,
    gamma: float | np.ndarray,
    bound: str = "TAYLOR",
    em_bayes: bool = False,
    ard: bool = False,
    l1: float = 0.0,
    stop: float = 0.0,
) -> tuple[np.ndarray, float | np.ndarray, float]:
    """Coordinate descent on the bound; returns (w, gamma, gamma * squared error).

    prec = sum a x^2 + rho gamma + 1e-5; w = (sum x (r + a w x) + rho gamma prior) / prec. With `em_bayes`
    gamma = (.005 + p) / (.005 + rho * SE), SE = sum((w - prior)^2 + 1 / prec); with `ard` one gamma per
    feature. `l1` adds an L1 dead zone around the prior (elastic net). `stop` ends once the log-likelihood
    changes by no more than it.
    """
    w = w.astype(np.float64).copy()
    prec = np.ones(x.p)
    se = np.zeros(x.p)
    last = None
    for _ in range(rounds):
        if stop > 0:
            now = log_likelihood(x, y, w)
            if last is not None and abs(now - last) <= stop:
                break
            last = now
        a, r = bound_terms(x, y, w, bound, prec)
        reg = rho * np.broadcast_to(np.asarray(gamma, np.float64), x.p)
        for j in range(x.p):
            k = slice(x.ptr[j], x.ptr[j + 1])
            rows, v = x.rows[k], x.vals[k]
            ax2 = float((a[rows] * v * v).sum())
            prec[j] = ax2 + reg[j] + 1e-5
            pull = float((v * (r[rows] + a[rows] * w[j] * v)).sum())
            if l1:
                off = pull - (ax2 + 1e-5) * prior[j]
                new = prior[j] + np.sign(off) * max(abs(off) - l1, 0.0) / prec[j]
            else:
                new = (pull + reg[j] * prior[j]) / prec[j]
            if abs(new - w[j]) > 1e-5:
                r[rows] += a[rows] * v * (w[j] - new)
            w[j] = new
        se = (w - prior) ** 2 + 1 / prec
        if ard:
            gamma = (PSEUDO + 1) / (PSEUDO + rho * se)
        elif em_bayes:
            gamma = (PSEUDO + x.p) / (PSEUDO + rho * float(se.sum()))
    return w, gamma, float((np.asarray(gamma) * se).sum())


def solve_t_prior(
    x: Design, y: np.ndarray, w: np.ndarray, prior: np.ndarray, rounds: int, shape: float, scale: float = 1.0, stop: float = 0.0, intercept: int = -1
) -> np.ndarray:
    """CG under a heavy-tailed t prior of the whole difference from `prior`.

    The log prior is -(shape + p/2) log(1 + R / (2 scale)), R the squared residual; it acts like a Gaussian prior of
    the weight (shape + p/2) / (scale + R/2), less its change along the direction. The intercept is free.
    """
    free = np.ones(x.p)
    if intercept >= 0:
        free[intercept] = 0.0
    w = w.astype(np.float64).copy()
    half = shape + x.p / 2
    last_g, d, last = None, None, None
    for _ in range(rounds):
        diff = free * (w - prior)
        r = float(diff @ diff)
        if stop > 0:
            now = log_likelihood(x, y, w) - half * np.log1p(r / (2 * scale))
            if last is not None and abs(now - last) <= stop:
                break
            last = now
        weight = half / (scale + r / 2)
        g = gradient(x, y, w) - weight * diff
        d = g if d is None else conjugate_direction(g, last_g, d)
        last_g = g
        along = float(d @ diff)
        den = curvature(x, y, w, d) + weight * (float(free @ d**2) - along * along / (scale + r / 2))
        if den <= 0 or not np.isfinite(den):
            break
        w += d * ((g @ d) / den)
    return w


def t_weight(w: np.ndarray, prior: np.ndarray, shape: float, scale: float) -> tuple[float, float]:
    """(weight of the Gaussian prior that a t prior acts like at w, squared residual)."""
    r = float(((w - prior) ** 2).sum())
    return (shape + len(w) / 2) / (scale + r / 2), r


def global_scalar(local: np.ndarray, eta: np.ndarray, gamma: np.ndarray, lam: float) -> float:
    """argmin over w of sum eta_k |w - w_k| + gamma_k / 2 (w - w_k)^2 + lam / 2 w^2, by search over the breakpoints."""
    order = np.argsort(local, kind="stable")
    w, e, q = local[order], eta[order], float(gamma.sum()) + lam
    pull = float(gamma @ local)
    below = np.concatenate([[0.0], np.cumsum(e)])
    lo, hi = 0, len(w)
    while lo < hi:  # the slope right of a breakpoint grows with it
        mid = (lo + hi) // 2
        slope = q * w[mid] - pull + below[mid + 1] - (below[-1] - below[mid + 1])
        lo, hi = (lo, mid) if slope >= 0 else (mid + 1, hi)
    if lo < len(w):
        left = q * w[lo] - pull + below[lo] - (below[-1] - below[lo])
        if left <= 0:
            return float(w[lo])
    shift = below[lo] - (below[-1] - below[lo])
    return float((pull - shift) / q) if q > 0 else float(w[min(lo, len(w) - 1)])
