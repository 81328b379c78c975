"""Logistic regression without intercept by Newton steps on sufficient statistics.

A step is one scan: every partition leaves the log likelihood, the gradient X'(y - p) and the information X'WX at the
current coefficients (:mod:`varkit.operators.partials`); the driver solves a k x k system.  Columns are scaled
by their root mean square.  A step that lowers the likelihood is halved.  Which columns are combinations of earlier ones is
read from the triangular factor of the table (:mod:`varkit.operators.qr`): they have no coefficient (NaN).  Where a
combination of the columns separates the labels the likelihood has no maximum, and the fit says so.
"""

from __future__ import annotations

import math
from typing import NamedTuple, Sequence

import numpy as np
from pyspark.sql import DataFrame

from varkit.operators.partials import merged
from varkit.operators.qr import dependent_columns, r_factor

MAX_STEPS, MAX_HALVINGS, TOLERANCE = 50, 30, 1e-12
#: Coefficients of so many (in columns of unit size) or a mean log likelihood this near 0 mean that the labels are separated.
SEPARATED_AT, SEPARATED_LOSS = 500.0, 1e-7


class LogitFit(NamedTuple):
    """Per column, in the given order; NaN where the column is a combination of earlier ones."""

    coef: np.ndarray
    se: np.ndarray
    z: np.ndarray
    p: np.ndarray
    loglik: float
    steps: int


def _statistics(x: DataFrame, theta: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """(log likelihood, gradient, information, rows) at ``theta``; the last column of ``x`` is the label."""
    k = len(theta)

    def scan(batches):
        total = np.zeros((k + 2, k + 1))
        for rows in batches:
            u, y = rows[:, :k] / scale, rows[:, k]
            eta = u @ theta
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -700, 700)))
            total[0, 0] += np.sum(y * eta - np.logaddexp(0.0, eta))
            total[0, k] += len(rows)
            total[1, :k] += u.T @ (y - p)
            total[2:, :k] += (u * (p * (1 - p))[:, None]).T @ u
        return total

    total = merged(x, scan, np.add)
    if total is None:
        return 0.0, np.zeros(k), np.zeros((k, k)), 0.0
    return float(total[0, 0]), total[1, :k], total[2:, :k], float(total[0, k])


def logit_fit(data: DataFrame, xcols: Sequence[str], y: str, start: Sequence[float] | None = None, r: np.ndarray | None = None) -> LogitFit:
    """Fit of ``y`` (0 or 1) on double columns ``xcols``, all without NULL.  ``start`` gives coefficients to start from
    and ``r`` the columns' triangular factor, where the caller has them."""
    xcols = list(xcols)
    k = len(xcols)
    r = r_factor(data, xcols) if r is None else r
    out = {name: np.full(k, np.nan) for name in ("coef", "se", "z", "p")}
    active = [j for j in range(k) if j not in set(dependent_columns(r))]
    if not active:
        return LogitFit(**out, loglik=0.0, steps=0)
    x = data.select(*[f"`{xcols[j]}`" for j in active], f"`{y}`")
    n = data.count()
    scale = np.sqrt((r[:, active] ** 2).sum(0) / n)
    theta = np.zeros(len(active)) if start is None else np.nan_to_num(np.asarray(start, float)[active]) * scale
    ll, gradient, information, _ = _statistics(x, theta, scale)
    steps = 0
    while True:
        delta = np.linalg.lstsq(information, gradient, rcond=1e-13)[0]
        if float(delta @ gradient) <= TOLERANCE * (abs(ll) + TOLERANCE):
            theta = theta + delta  # the last step's error is the square of this one's
            break
        if steps == MAX_STEPS:
            raise ArithmeticError(f"the logistic fit has not converged in {MAX_STEPS} steps")
        steps += 1
        for _ in range(MAX_HALVINGS):
            new = _statistics(x, theta + delta, scale)
            if new[0] >= ll - 1e-12 * abs(ll):
                break
            delta = delta / 2
        theta, (ll, gradient, information, _) = theta + delta, new
        if np.abs(theta).max() > SEPARATED_AT or ll > -SEPARATED_LOSS * n:
            raise ArithmeticError("a combination of the columns separates the labels: the logistic fit has no maximum")
    se = np.sqrt(np.diag(np.linalg.inv(information)))
    out["coef"][active], out["se"][active] = theta / scale, se / scale
    out["z"][active] = theta / se
    out["p"][active] = [math.erfc(abs(z) / math.sqrt(2.0)) for z in theta / se]
    return LogitFit(**out, loglik=ll, steps=steps)
