"""Topic model updates in numpy. A document is (words, counts); gamma has shape (topics,)."""

from __future__ import annotations

import numpy as np

from quorix.functions import special as S

PHI_FLOOR = 1e-30
POSITIVE_FLOOR = 1e-5
MEAN_CHANGE = 1e-3


def e_step(words: np.ndarray, counts: np.ndarray, exp_beta: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(gamma, statistics topics x words of this document, without the factor e^{E log beta}).

    gamma = alpha + e^{E log theta} * sum_w (c_w / phi_w) e^{E log beta_w}; stops when the mean absolute
    change is at most 1e-3. `exp_beta` holds the columns of this document's words.
    """
    theta = S.exp_dirichlet_expectation(gamma)
    phi = np.maximum(theta @ exp_beta, PHI_FLOOR)
    for _ in range(rounds):
        new = alpha + theta * (exp_beta @ (counts / phi))
        change = np.abs(new - gamma).mean()
        gamma = new
        theta = S.exp_dirichlet_expectation(gamma)
        phi = np.maximum(theta @ exp_beta, PHI_FLOOR)
        if change <= MEAN_CHANGE:
            break
    return gamma, theta[:, None] * (counts / phi)[None, :]


def e_step_log(words: np.ndarray, counts: np.ndarray, log_beta: np.ndarray, alpha: np.ndarray, gamma: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The same in log space; returns (gamma, full statistics counts * responsibility)."""
    resp = None
    for _ in range(max(1, rounds)):
        lt = S.dirichlet_expectation(gamma)
        joint = lt[:, None] + log_beta
        top = joint.max(0)
        resp = np.exp(joint - (top + np.log(np.exp(joint - top).sum(0))))
        new = alpha + resp @ counts
        change = np.abs(new - gamma).mean()
        gamma = new
        if change <= MEAN_CHANGE:
            break
    return gamma, resp * counts


def m_step(stats: np.ndarray, exp_beta: np.ndarray, beta: np.ndarray | float) -> np.ndarray:
    """eta = stats * e^{E log beta} + prior; non-positive entries become 1e-5."""
    eta = stats * exp_beta + beta
    return np.where(eta <= 0, POSITIVE_FLOOR, eta)


def fit_local(docs: list[tuple[np.ndarray, np.ndarray]], eta: np.ndarray, beta: np.ndarray | float, alpha: np.ndarray, rounds: int, inner: int, gammas: list[np.ndarray] | None = None, log_space: bool = False, update_alpha: bool = False) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Batch variational Bayes over local documents: (eta, gammas, alpha). Empty documents are skipped."""
    topics = len(eta)
    gammas = [np.ones(topics) for _ in docs] if gammas is None else [g.copy() for g in gammas]
    for _ in range(rounds):
        log_beta = S.dirichlet_expectation(eta)
        exp_beta = np.exp(log_beta)
        stats = np.zeros_like(eta)
        for d, (w, c) in enumerate(docs):
            if not len(w):
                continue
            if log_space:
                gammas[d], s = e_step_log(w, c, log_beta[:, w], alpha, gammas[d], inner)
                s = s / np.maximum(exp_beta[:, w], PHI_FLOOR)
            else:
                gammas[d], s = e_step(w, c, exp_beta[:, w], alpha, gammas[d], inner)
            np.add.at(stats, (slice(None), w), s)
        eta = m_step(stats, exp_beta, beta)
        if update_alpha and docs:
            alpha = newton_alpha(alpha, np.array(gammas))
    return eta, gammas, alpha


def newton_alpha(alpha: np.ndarray, gammas: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Linear-time Newton for the Dirichlet parameter; stops at a mean absolute gradient of 1e-3."""
    return newton_alpha_from(alpha, S.dirichlet_expectation(gammas).sum(0), len(gammas), rounds)


def newton_alpha_from(alpha: np.ndarray, expected: np.ndarray, n: int, rounds: int = 20) -> np.ndarray:
    """The same from the summed expectations of log theta of n documents."""
    alpha = np.array(alpha, float)
    for _ in range(rounds):
        g = n * (S.digamma(np.array([alpha.sum()]))[0] - S.digamma(alpha)) + expected
        q = -n * S.trigamma(alpha)
        z = n * S.trigamma(np.array([alpha.sum()]))[0]
        b = (g / q).sum() / (1 / z + (1 / q).sum())
        alpha = alpha - (g - b) / q
        alpha = np.where(alpha <= 0, POSITIVE_FLOOR, alpha)
        if np.abs(g).mean() <= 1e-3:
            break
    return alpha


def newton_alpha_scalar(alpha: float, expected: float, n: int, topics: int, rounds: int = 50) -> float:
    """Newton in log space for a symmetric parameter."""
    a = float(alpha)
    for _ in range(rounds):
        one, all_ = np.array([a]), np.array([a * topics])
        df = n * topics * (S.digamma(all_)[0] - S.digamma(one)[0]) + expected
        d2 = n * topics * (topics * S.trigamma(all_)[0] - S.trigamma(one)[0])
        step = df / (d2 * a + df)
        a = float(np.exp(np.log(a) - step)) if np.isfinite(step) else a
        if abs(df) <= 1e-5:
            break
    return a


def log_likelihood(words: np.ndarray, counts: np.ndarray, gamma: np.ndarray, beta: np.ndarray) -> float:
    """sum of count * log(theta . beta) with normalised theta; `beta` holds this document's columns."""
    return float(counts @ np.log(np.maximum((gamma / gamma.sum()) @ beta, 1e-300)))


def document_bound(words: np.ndarray, counts: np.ndarray, gamma: np.ndarray, alpha: np.ndarray, log_beta: np.ndarray) -> float:
    """The document's part of the evidence lower bound."""
    lt = S.dirichlet_expectation(gamma)
    joint = lt[:, None] + log_beta
    top = joint.max(0)
    score = float(counts @ (top + np.log(np.exp(joint - top).sum(0))))
    score += float(((alpha - gamma) * lt + S.lgamma(gamma) - S.lgamma(alpha)).sum())
    return score + float(S.lgamma(alpha.sum()) - S.lgamma(gamma.sum()))


def topic_bound(eta: np.ndarray, beta: float) -> float:
    """The topics' part of the evidence lower bound."""
    lb = S.dirichlet_expectation(eta)
    vocabulary = eta.shape[1]
    score = float(((beta - eta) * lb + S.lgamma(eta) - S.lgamma(np.array(beta))).sum())
    return score + float((S.lgamma(np.array(beta * vocabulary)) - S.lgamma(eta.sum(1))).sum())
