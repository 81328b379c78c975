"""Missing values, wide integers and names at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varkit import profile
from varkit.operators.moments import correlation_matrix, gram_matrix
from varkit.operators import logit
from varkit.operators.reduce import _vif_from_moments, backward_selection
from varkit.operators.score import gains_table
from varkit.operators.treat import cap_floor, dummies, smooth_tails

NAN = float("nan")


def test_nan_is_missing_in_cap_floor_and_smoothing(spark):
    df = spark.createDataFrame([(NAN,), (5.0,), (50.0,), (None,)], "x double")
    got = [r.x for r in cap_floor(df, "x", 10.0, 6.0).collect()]
    assert np.isnan(got[0]) and got[1:] == [6.0, 10.0, None]
    rows = [(float(i), i) for i in range(101)]
    plain = {r.k: r.x for r in smooth_tails(spark.createDataFrame(rows, "x double, k long"), "x", "k").collect()}
    mixed = {r.k: r.x for r in smooth_tails(spark.createDataFrame([*rows, (NAN, 500), (None, 501)], "x double, k long"), "x", "k").collect()}
    assert np.isnan(mixed.pop(500)) and mixed.pop(501) is None and mixed == plain


def test_missing_scores_rank_last(spark):
    rows = [(float(i), 1, "s", i) for i in range(18)] + [(None, 0, "s", 100), (NAN, 0, "s", 101)]
    table, bounds = gains_table(spark.createDataFrame(rows, "p double, t int, s string, k long"), "p", "t", "s", "k")
    got = {r.bucket: (r.min_prob, r.max_prob, r.counts) for r in table.collect()}
    assert sum(v[2] for v in got.values()) == 20 and got[1] == (17.0, 17.0, 1)
    assert got[10] == (0.0, 0.0, 2) or got[10][2] == 2 and got[11] == (None, None, 1)


def test_wide_integers_and_all_null_columns(spark):
    df = spark.createDataFrame([(2**53, None), (2**53 + 1, None), (2**53 + 2, None)], "big long, none double")
    got = {r.variable: r.unique for r in profile(df).collect()}
    assert got == {"big": 3, "none": 0}


def test_dummies_that_differ_in_case(spark):
    out, cats = dummies(spark.createDataFrame([("A",), ("A",), ("A",), ("a",), ("a",), ("z",)], "c string"), "c")
    assert cats == ["A", "a"] and out.columns == ["c", "c_dum_A", "c_dum_a_2"]
    assert [tuple(r)[1:] for r in out.collect()].count((0, 1)) == 2


def test_one_scan_moments_with_nulls_against_numpy(spark):
    rng = np.random.default_rng(3)
    k, n = 120, 400
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + 1000
    x[rng.random((n, k)) < 0.1] = np.nan
    df = spark.createDataFrame(x.tolist(), [f"c{i}" for i in range(k)]).repartition(7)
    _, got = correlation_matrix(df)
    for i, j in rng.integers(0, k, (200, 2)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    small = df.select("c0", "c1", "c2")
    rows, g = gram_matrix(small, ["c0", "c1", "c2"])
    full = x[:, :3][~np.isnan(x[:, :3]).any(1)]
    assert rows == len(full) and np.allclose(g, full.T @ full)
    for width in (40, 41, 60):
        assert gram_matrix(df.limit(0), df.columns[:width])[0] == 0
    const = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 4.0)], "a double, b double")
    assert np.isnan(correlation_matrix(const)[1][0, 1])


def test_vif_by_one_inverse():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[:, 5] += 2 * x[:, 0]
    c = np.corrcoef(x.T)
    want = [1 / (1 - c[i, r] @ np.linalg.solve(c[np.ix_(r, r)], c[r, i])) for i in range(6) for r in [np.delete(np.arange(6), i)]]
    assert np.allclose(_vif_from_moments(c), want)
    x[:, 5] = x[:, 0] + x[:, 1]
    assert np.isinf(_vif_from_moments(np.corrcoef(x.T))[[0, 1, 5]]).all()


def test_logit_selection_checks_label_and_convergence(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 3)) for i in range(60)], "a double, b double, y double")
    with pytest.raises(ValueError, match="0 or 1"):
        backward_selection(df, "y", regression=False)
    data = df.withColumn("y", (F.col("a") > 2).cast("double"))
    monkeypatch.setattr(logit, "MAX_STEPS", 1)
    with pytest.raises(ArithmeticError, match="converged"):
        logit.logit_fit(data, ["a", "b"], "y")
