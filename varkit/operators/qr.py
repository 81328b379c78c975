"""Tall-skinny QR: the triangular factor of a table, in one scan.

Every Arrow batch is factored together with the factor of the rows before it; factors of partitions are stacked
and factored again.  R is that of the whole table up to the signs of its rows, which are made positive
on the diagonal.  Unlike the Cholesky factor of X'X it does not square the condition number, so columns that
differ in the ninth digit are told apart.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame

from varkit.operators.moments import complete_rows
from varkit.operators.partials import merged

#: A column whose part outside the columns before it is at most this share of it is a combination of them.
COLLINEAR = 1e-10


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, as a square array (rows of zeros below where there are fewer rows than columns)."""
    k = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    if len(r) < k:
        r = np.vstack([r, np.zeros((k - len(r), k))])
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def r_factor(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The k x k factor R of the complete rows of the columns; zeros without rows."""
    cols = list(cols)
    if not cols:
        return np.zeros((0, 0))

    def scan(batches):
        r = None
        for rows in batches:
            r = _triangle(rows if r is None else np.vstack([r, rows]))
        return r

    r = merged(complete_rows(df, cols), scan, lambda a, b: _triangle(np.vstack([a, b])))
    return np.zeros((len(cols), len(cols))) if r is None else r


def pivot_shares(r: np.ndarray) -> np.ndarray:
    """Per column the share of its length that lies outside the columns before it (0 for a column of zeros)."""
    length = np.sqrt((r * r).sum(0))
    return np.abs(np.diag(r)) / np.where(length > 0, length, 1.0)


def dependent_columns(r: np.ndarray, tol: float = COLLINEAR) -> list[int]:
    """Columns that are combinations of those before them, in column order.  A dependent column takes no part
    in judging the columns after it."""
    kept: list[int] = []
    out = []
    for j in range(r.shape[1]):
        sub = _triangle(r[:, kept + [j]])
        if pivot_shares(sub)[-1] <= tol:
            out.append(j)
        else:
            kept.append(j)
    return out
