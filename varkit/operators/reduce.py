"""Variable reduction: correlation clusters, cluster representatives, variance
inflation and backward selection.

Each reducer makes one pass over the data for its sufficient statistics
(correlation or Gram matrix, :mod:`varkit.operators.moments`); the iterations
then work on a k x k array on the driver instead of refitting a model on the
full table per step.  Exact collinearity is judged on the triangular factor of the table
(:mod:`varkit.operators.qr`); the logistic path of backward selection takes one scan per Newton
step (:mod:`varkit.operators.logit`).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varkit.functions.columns import numeric_value
from varkit.functions.distributions import t_sf2
from varkit.operators.logit import logit_fit
from varkit.operators.moments import correlation_matrix, gram_matrix
from varkit.operators.qr import dependent_columns, r_factor


# ------------------------------------------------------------------ clusters
def _components(cols: list[str], corr: np.ndarray, cutoff: float) -> dict[int, list[str]]:
    """Connected components of the graph |r| > cutoff (strict; NaN is no edge),
    discovered in column order, members in depth-first order."""
    k = len(cols)
    adj = [[j for j in range(k) if j != i and abs(corr[i, j]) > cutoff] for i in range(k)]
    seen = [False] * k
    clusters: dict[int, list[str]] = {}
    for start in range(k):
        if seen[start]:
            continue
        members: list[int] = []
        stack = [start]
        while stack:  # iterative depth-first preorder, neighbours in column order
            i = stack.pop()
            if seen[i]:
                continue
            seen[i] = True
            members.append(i)
            stack.extend(j for j in reversed(adj[i]) if not seen[j])
        clusters[len(clusters)] = [cols[i] for i in members]
    return clusters


def correlation_clusters(df: DataFrame, cutoff: float = .7,
                         cols: Sequence[str] | None = None) -> dict[int, list[str]]:
    """``{cluster_id: [columns]}``: connected components of |r| > cutoff over the
    numeric columns (pairwise-complete Pearson r)."""
    names, corr = correlation_matrix(df, cols)
    return _components(names, corr, cutoff)


def clusters_frame(spark, clusters: dict[int, list[str]]) -> DataFrame:
    rows = [(int(cid), v, i) for cid, members in clusters.items() for i, v in enumerate(members)]
    return spark.createDataFrame(rows, "cluster long, variable string, member long")


def _unexplained(corr: np.ndarray, members: np.ndarray) -> np.ndarray:
    """1 - R^2 of every column regressed (with intercept) on the given member columns other than
    itself, from one factorization of the members' correlations.

    Outside the cluster it is 1 - r' C^-1 r.  For a member it is the reciprocal of its diagonal
    entry of C^-1, which holds the regression on the remaining members.
    """
    block = corr[np.ix_(members, members)]
    inverse = np.linalg.pinv(block, hermitian=True)
    across = corr[:, members]
    left = 1.0 - np.einsum("ij,jk,ik->i", across, inverse, across)
    diagonal = np.diag(inverse).copy()
    singular = np.linalg.matrix_rank(block, hermitian=True) < len(members)
    if singular:
        for i in range(len(members)):
            rest = np.delete(members, i)
            r = corr[rest, members[i]]
            left[members[i]] = 1.0 - r @ np.linalg.pinv(corr[np.ix_(rest, rest)], hermitian=True) @ r
    else:
        left[members] = 1.0 / diagonal
    return left


def varclus_table(df: DataFrame, cutoff: float, cols: Sequence[str] | None = None,
                  maxkeep: int = 1, maxdrop: int | None = None) -> list[dict]:
    """Per column: cluster, R^2 with its own cluster, R^2 with the nearest other
    cluster, the ratio (1-R2own)/(1-R2next) and whether it is kept.

    Clusters are an integer label per column.  The nearness of two clusters is the largest |r| between them, a
    masked maximum of the matrix; a cluster without any correlation to others has R2next = 0.
    """
    names, corr = correlation_matrix(df, cols, complete=True)
    corr = np.nan_to_num(corr)
    at = {name: i for i, name in enumerate(names)}
    clusters = _components(names, corr, cutoff)
    members = [np.array([at[c] for c in clusters[label]], int) for label in range(len(clusters))]
    label = np.empty(len(names), int)
    for number, m in enumerate(members):
        label[m] = number
    strength = np.abs(corr)
    strength[label[:, None] == label[None, :]] = 0.0
    to_cluster = np.stack([strength[:, m].max(axis=1) for m in members], axis=1) if members else np.zeros((0, 0))
    size = np.bincount(label, minlength=len(members))
    wanted = {int(c) for c in np.flatnonzero(size > 1)}
    nearest = {c: int(np.argmax(to_cluster[members[c]].max(axis=0))) for c in wanted if to_cluster[members[c]].max() > 0}
    left = {c: _unexplained(corr, members[c]) for c in wanted | set(nearest.values())}

    rows = []
    for number, m in enumerate(members):
        if size[number] == 1:
            rows.append(dict(variable=names[m[0]], cluster=number, r2_own=None, r2_next=None, ratio=None, kept=True))
            continue
        own = left[number][m]
        other = left[nearest[number]][m] if number in nearest else np.ones(len(m))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = own / other
        place = np.empty(len(m), int)
        place[np.argsort(ratio, kind="stable")] = np.arange(len(m))
        cut = len(m) - maxdrop if maxdrop is not None else maxkeep
        rows += [dict(variable=names[i], cluster=number, r2_own=float(1 - a), r2_next=float(1 - b), ratio=float(q), kept=bool(k < cut))
                 for i, a, b, q, k in zip(m, own, other, ratio, place)]
    return rows


def varclus(df: DataFrame, cutoff: float, maxkeep: int = 1, maxdrop: int | None = None,
            cols: Sequence[str] | None = None) -> list[str]:
    """Columns kept: from each cluster the ``maxkeep`` columns with the lowest
    (1-R2own)/(1-R2next) (or all but the ``maxdrop`` highest), singletons always.
    A cluster with no correlated neighbour uses R2next = 0."""
    rows = varclus_table(df, cutoff, cols, maxkeep, maxdrop)
    out = []
    for cid in dict.fromkeys(r["cluster"] for r in rows):
        members = [r for r in rows if r["cluster"] == cid and r["kept"]]
        out += [r["variable"] for r in sorted(members, key=lambda r: (r["ratio"] is not None, r["ratio"] or 0))]
    return out


# ------------------------------------------------------------------------ VIF
def _scaled_inverse(g: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(g))
    d[d == 0] = 1.0
    gs = g / np.outer(d, d)
    return np.linalg.pinv(gs) / np.outer(d, d)


def _vif_from_moments(m: np.ndarray, rel_tol: float = 1e-12) -> np.ndarray:
    """1 / (1 - R^2_i) for every column i regressed on the others, from a moment
    matrix (Gram matrix: uncentred R^2, no intercept; correlation matrix:
    centred): m_ii * (m^-1)_ii, one inverse for all columns.  Only where the matrix is numerically
    singular is each column solved for itself; an exactly collinear column gets infinity."""
    k = m.shape[0]
    if k == 1:
        return np.ones(1)
    d = np.sqrt(np.diag(m))
    d[d == 0] = 1.0
    s = m / np.outer(d, d)
    if np.isfinite(s).all() and np.linalg.cond(s) < 1 / rel_tol:
        return np.diag(np.linalg.inv(s)) * np.diag(s)
    out = np.empty(k)
    for i in range(k):
        rest = np.delete(np.arange(k), i)
        si = s[rest, i]
        rss = s[i, i] - si @ np.linalg.pinv(s[np.ix_(rest, rest)], hermitian=True) @ si
        out[i] = np.inf if rss <= rel_tol * s[i, i] else s[i, i] / rss
    return out


def _raw_vif(g: np.ndarray) -> np.ndarray:
    """VIF without intercept (uncentred R^2): G_ii * (G^-1)_ii."""
    return _vif_from_moments(g)


def _check_not_constant(df: DataFrame, cols: list[str]) -> None:
    row = df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(cols)]).collect()[0]
    const = [c for i, c in enumerate(cols) if row[f"s{i}"] is not None and row[f"s{i}"] == 0]
    if const:
        raise ValueError(f"constant columns are not supported by the uncentred VIF: {const}")


def vif_table(df: DataFrame, cols: Sequence[str] | None = None) -> list[tuple[str, float]]:
    """First-round uncentred VIF of every column (no intercept added)."""
    from varkit.functions.columns import numerical_categorical_division
    cols = numerical_categorical_division(df, cols)[0]
    _, g = gram_matrix(df, cols)
    return list(zip(cols, [float(v) for v in _raw_vif(g)]))


def _vif_rounds(m: np.ndarray, alive: list[int], limit: float) -> list[tuple[int, float]]:
    """(column, its VIF) in the order of dropping, from a moment matrix: the largest VIF goes (the first of equal
    ones) while it exceeds ``limit`` and more than one column is left."""
    out = []
    while len(alive) > 1:
        v = _vif_from_moments(m[np.ix_(alive, alive)])
        top = int(np.argmax(v))
        if not v[top] > limit:
            break
        out.append((alive[top], float(v[top])))
        alive = alive[:top] + alive[top + 1:]
    return out


def vif_rounds(df: DataFrame, limit: float = 2.5, cols: Sequence[str] | None = None, centred: bool = False) -> list[tuple[str, float]]:
    """(column, VIF when it was dropped) of the reduction, uncentred or on the correlations of complete rows."""
    from varkit.functions.columns import numerical_categorical_division
    cols = numerical_categorical_division(df, cols)[0]
    m = correlation_matrix(df, cols, complete=True)[1] if centred else gram_matrix(df, cols)[1]
    return [(cols[j], v) for j, v in _vif_rounds(m, list(range(len(cols))), limit)]


def vif_reduction(df: DataFrame, limit: float = 2.5, cols: Sequence[str] | None = None) -> list[str]:
    """Drop the column with the largest uncentred VIF while it exceeds ``limit``;
    returns the dropped columns in order.  One Gram pass; the loop inverts
    sub-matrices of the k x k Gram matrix.  Stops at one remaining column."""
    from varkit.functions.columns import numerical_categorical_division
    cols = numerical_categorical_division(df, cols)[0]
    _check_not_constant(df, cols)
    _, g = gram_matrix(df, cols)
    return [cols[j] for j, _ in _vif_rounds(g, list(range(len(cols))), limit)]


def vif_reduction_corr(df: DataFrame, limit: float = 2.5, cols: Sequence[str] | None = None) -> list[str]:
    """Alternate reducer: drop exactly collinear columns first, then repeatedly the
    column with the largest centred VIF (diagonal of the inverse correlation
    matrix) while it exceeds ``limit``.  Returns all dropped columns in order."""
    from varkit.functions.columns import numerical_categorical_division
    cols = numerical_categorical_division(df, cols)[0]
    names, corr = correlation_matrix(df, cols, complete=True)
    gone = dependent_columns(r_factor(df, cols))
    alive = [i for i in range(len(cols)) if i not in gone]
    return [cols[j] for j in gone] + [cols[j] for j, _ in _vif_rounds(corr, alive, limit)]


def centred_vif(df: DataFrame, cols: Sequence[str] | None = None) -> list[tuple[str, float]]:
    names, corr = correlation_matrix(df, cols, complete=True)
    return list(zip(names, [float(v) for v in _vif_from_moments(corr)]))


# --------------------------------------------------------- backward selection
def ols_no_intercept(df: DataFrame, dv: str, cols: Sequence[str]) -> list[dict]:
    """OLS of ``dv`` on ``cols`` without intercept from one Gram pass: per column
    coefficient, standard error, t and two-sided p (n - k degrees of freedom)."""
    cols = list(cols)
    n, g = gram_matrix(df, cols + [dv])
    return _ols_from_gram(n, g, list(range(len(cols))), len(cols), cols)


def _ols_from_gram(n: int, g: np.ndarray, xs: list[int], y: int, names: list[str]) -> list[dict]:
    gxx = g[np.ix_(xs, xs)]
    gxy = g[xs, y]
    inv = _scaled_inverse(gxx)
    beta = inv @ gxy
    rss = float(g[y, y] - beta @ gxy)
    dof = n - len(xs)
    sigma2 = rss / dof if dof > 0 else float("nan")
    out = []
    for i, j in enumerate(xs):
        se = float(np.sqrt(sigma2 * inv[i, i])) if sigma2 == sigma2 and inv[i, i] > 0 else float("nan")
        t = float(beta[i] / se) if se == se and se > 0 else float("nan")
        out.append(dict(variable=names[j], coef=float(beta[i]), se=se, t=t, p=t_sf2(t, dof)))
    return out


def _pick_drop(pvals: Sequence[float], alpha: float) -> int | None:
    """NaN p-values are dropped first (column order), then the largest above alpha."""
    for i, p in enumerate(pvals):
        if p != p:
            return i
    top = int(np.argmax(pvals))
    return top if pvals[top] > alpha else None


def backward_steps(df: DataFrame, dv: str, regression: bool = True, alpha: float = .05,
                   cols: Sequence[str] | None = None) -> list[tuple[str, float, float]]:
    """``(column, statistic, p)`` of the columns that backward elimination drops (no intercept), in order, with
    their values at the time: OLS t-tests when ``regression``, logit Wald tests otherwise.  Stops at one column.

    OLS needs one scan in all, its Gram matrix.  A logistic selection takes the triangular factor in one scan and then
    one scan per Newton step; after a drop it starts from the coefficients of the columns that stay.
    """
    from varkit.functions.columns import numerical_categorical_division
    cols = [c for c in numerical_categorical_division(df, cols)[0] if c != dv]
    alive = list(range(len(cols)))
    out: list[tuple[str, float, float]] = []
    if regression:
        n, g = gram_matrix(df, cols + [dv])
        while len(alive) > 1:
            res = _ols_from_gram(n, g, alive, len(cols), cols)
            pick = _pick_drop([r["p"] for r in res], alpha)
            if pick is None:
                break
            out.append((cols[alive[pick]], res[pick]["t"], res[pick]["p"]))
            del alive[pick]
        return out
    names = [f"_x{i}" for i in range(len(cols))]
    data = df.select(*[numeric_value(df, c).alias(x) for c, x in zip(cols, names)], numeric_value(df, dv).alias("_y")).dropna().persist()
    try:
        if data.where("_y NOT IN (0, 1)").limit(1).count():
            raise ValueError("the label of a logistic selection must be 0 or 1")
        r = r_factor(data, names)
        start = None
        while len(alive) > 1:
            fit = logit_fit(data, [names[i] for i in alive], "_y", start=start, r=r[:, alive])
            pick = _pick_drop(list(fit.p), alpha)
            if pick is None:
                break
            out.append((cols[alive[pick]], float(fit.z[pick]), float(fit.p[pick])))
            start = np.delete(fit.coef, pick)
            del alive[pick]
    finally:
        data.unpersist()
    return out


def backward_selection(df: DataFrame, dv: str, regression: bool = True, alpha: float = .05,
                       cols: Sequence[str] | None = None) -> list[str]:
    """Columns dropped by :func:`backward_steps`, in order."""
    return [c for c, _, _ in backward_steps(df, dv, regression, alpha, cols)]
