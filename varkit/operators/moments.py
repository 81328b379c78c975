"""Moment matrices in one scan: pairwise correlations and the Gram matrix, for any number of columns.

Each partition sums products of its rows, shifted by the mean of its first batch, as matrix products
over Arrow batches: counts, sums, squares and cross products per pair of columns, with missing
values masked, so pairwise-complete moments need no pass of their own.  Partial
results are merged by ``FAN_IN`` tasks, whose sums the driver adds up.
"""

from __future__ import annotations

from itertools import combinations
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varkit.functions.columns import numeric_value, numerical_categorical_division

FAN_IN = 32


def _numeric_cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return numerical_categorical_division(df, cols)[0]


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The listed columns as doubles (NaN folded to NULL), rows with any NULL dropped."""
    x = df.select(*[numeric_value(df, c).alias(f"_x{i}") for i, c in enumerate(cols)])
    return x.dropna()


def _merge(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of two or more partial results, shifted to the centre of the first.  A partial result is
    [centre, N, S, Q, P]: per pair (i, j), over rows that have both, the number of rows and the
    sums of x_i, x_i^2 and x_i x_j."""
    total = parts[0].copy()
    for p in parts[1:]:
        d = p[0, 0] - total[0, 0]
        n, s, q, c = p[1], p[2], p[3], p[4]
        total[1] += n
        total[2] += s + n * d[:, None]
        total[3] += q + 2 * s * d[:, None] + n * (d * d)[:, None]
        total[4] += c + s * d[None, :] + s.T * d[:, None] + n * np.outer(d, d)
    return total


def _pack(parts: list[np.ndarray], group: int) -> pd.DataFrame:
    return pd.DataFrame({"g": [group] * bool(parts), "m": [_merge(parts).tobytes()] * bool(parts)})


def pair_sums(x: DataFrame, centred: bool = True) -> np.ndarray | None:
    """The merged result of ``_merge`` over all rows of ``x`` (double columns); None without rows."""
    k, names = len(x.columns), list(x.columns)

    def scan(batches):
        from pyspark import TaskContext
        total = None
        for b in batches:
            v = b[names].to_numpy(np.float64, na_value=np.nan)
            if not len(v):
                continue
            have = ~np.isnan(v)
            centre = np.zeros(k)
            if centred:
                centre = np.where(have.any(0), np.where(have, v, 0).sum(0) / np.maximum(have.sum(0), 1), 0.0)
                if total is not None:
                    centre = total[0, 0]
            u, m = np.where(have, v - centre, 0.0), have.astype(np.float64)
            part = np.stack([np.tile(centre, (k, 1)), m.T @ m, u.T @ m, (u * u).T @ m, u.T @ u])
            total = part if total is None else _merge([total, part])
        if total is not None:
            yield _pack([total], TaskContext.get().partitionId())

    def fold(batches):
        total, first = None, 0
        for b in batches:
            for g, m in zip(b["g"], b["m"]):
                part = np.frombuffer(m, np.float64).reshape(5, k, k)
                total, first = (part, int(g)) if total is None else (_merge([total, part]), first)
        if total is not None:
            yield _pack([total], first)

    rows = x.mapInPandas(scan, "g int, m binary")
    # by the number of the partial result, however many there are: each of the tasks adds up its share as a stream
    rows = rows.repartition(FAN_IN, F.col("g") % FAN_IN).sortWithinPartitions("g").mapInPandas(fold, "g int, m binary")
    found = [np.frombuffer(r.m, np.float64).reshape(5, k, k) for r in rows.orderBy("g").collect()]
    return _merge(found) if found else None


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       complete: bool = False) -> tuple[list[str], np.ndarray]:
    """Pearson correlations.  ``complete=False``: each pair over the rows where both are present
    (pairwise complete); ``complete=True``: over rows with no NULL.  A column constant on the shared
    rows gives NaN."""
    cols = _numeric_cols(df, cols)
    k = len(cols)
    if k < 2:
        return cols, np.eye(k)
    x = complete_rows(df, cols) if complete else df.select(*[numeric_value(df, c).alias(f"_x{i}") for i, c in enumerate(cols)])
    sums = pair_sums(x)
    out = np.full((k, k), np.nan)
    if sums is None:
        return cols, out
    centre, n, s, q, p = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = q - s * s / n                                 # of x_i over the rows shared with x_j
        floor = 1e-24 * n * (centre[0] ** 2)[:, None]          # what rounding leaves of a constant
        spread = np.where(spread > floor, spread, np.nan)
        out = (p - s * s.T / n) / np.sqrt(spread * spread.T)
    out = np.clip(out, -1.0, 1.0)
    np.fill_diagonal(out, np.where(np.isnan(np.diag(spread)), np.nan, 1.0))
    return cols, out


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """Uncentred cross-product matrix X'X over complete rows, and the row count."""
    cols = list(cols)
    sums = pair_sums(complete_rows(df, cols), centred=False)
    if sums is None:
        return 0, np.zeros((len(cols), len(cols)))
    return int(sums[1, 0, 0]), sums[4]


def long_pairs(spark, cols: list[str], m: np.ndarray):
    """Correlation matrix as a DataFrame ``var_a, var_b, r`` (a before b in column order)."""
    rows = [(cols[i], cols[j], None if np.isnan(m[i, j]) else float(m[i, j]))
            for i, j in combinations(range(len(cols)), 2)]
    return spark.createDataFrame(rows, "var_a string, var_b string, r double")
