"""Least squares and its penalised forms from moment matrices alone.

Small dense solves on d*d statistics; the rows they summarise stay distributed.
"""

from __future__ import annotations

import numpy as np

from descria.errors import NotConvergedError
from descria.operators import gram


def ols_from_moments(train: gram.Moments, rows: np.ndarray, y: int) -> tuple[np.ndarray, float]:
    """Minimum-norm least-squares coefficients and intercept (in shifted units)."""
    mean = train.s / train.n
    cov = train.g / train.n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[rows], 0.0))
    sd[sd == 0.0] = 1.0
    unit = cov[np.ix_(rows, rows)] / np.outer(sd, sd)
    beta = np.linalg.pinv(unit, rcond=1e-12, hermitian=True) @ (cov[rows, y] / sd) / sd
    return beta, float(mean[y] - beta @ mean[rows])


def score_from_moments(held: gram.Moments, rows: np.ndarray, y: int, beta: np.ndarray, b0: float) -> tuple[float, float]:
    """(R2, MSE) of a linear model on the rows summarised by ``held``."""
    n = held.n
    cross = held.g[rows, y] - b0 * held.s[rows]
    sse = (
        held.g[y, y]
        - 2.0 * b0 * held.s[y]
        + n * b0 * b0
        - 2.0 * beta @ cross
        + beta @ held.g[np.ix_(rows, rows)] @ beta
    )
    sse = max(float(sse), 0.0)
    sst = float(held.g[y, y] - held.s[y] ** 2 / n)
    if sst <= gram.CONSTANT_EPS * abs(held.g[y, y]):
        return (1.0 if sse == 0.0 else 0.0), sse / n
    return 1.0 - sse / sst, sse / n


def penalised_from_moments(
    train: gram.Moments, d: int, l1: float, l2: float, scaled: bool = True
) -> tuple[np.ndarray, float]:
    """Coefficients of the first ``d`` columns for the last one.

    The penalty acts on standardised columns, or on raw ones without ``scaled``.
    """
    rows = np.arange(d)
    if l1 == 0.0 and l2 == 0.0:
        return ols_from_moments(train, rows, d)
    mean = train.s / train.n
    cov = train.g / train.n - np.outer(mean, mean)
    var = np.diag(cov)[:d]
    std = np.where(var > gram.CONSTANT_EPS * np.diag(train.g)[:d] / train.n, np.sqrt(np.maximum(var, 0)), np.inf)
    if not scaled:
        std = np.where(np.isfinite(std), 1.0, np.inf)
    c, b = cov[:d, :d] / np.outer(std, std), cov[:d, d] / std
    if l1 == 0.0:
        w = np.linalg.solve(c + l2 * np.eye(d), b)
    else:
        w = np.zeros(d)
        for _ in range(10_000):
            moved = 0.0
            for j in range(d):
                if c[j, j] == 0.0:
                    continue
                rho = b[j] - c[j] @ w + c[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (c[j, j] + l2)
                moved, w[j] = max(moved, abs(new - w[j])), new
            if moved <= 1e-10 * (np.abs(w).max() + 1e-300):
                break
        else:
            raise NotConvergedError("coordinate descent did not converge in 10000 sweeps")
    beta = w / std
    return beta, float(mean[d] - beta @ mean[:d])


def subset(m: gram.Moments, rows: np.ndarray) -> gram.Moments:
    """Moments of some of the columns."""
    return gram.Moments(m.n, m.s[rows], m.g[np.ix_(rows, rows)], m.shift[rows])


def column_std(m: gram.Moments) -> np.ndarray:
    """Population standard deviation per column; 0 for constant columns."""
    var = np.diag(m.g) / m.n - (m.s / m.n) ** 2
    floor = gram.CONSTANT_EPS * np.diag(m.g) / m.n
    return np.sqrt(np.where(var > floor, var, 0.0))
