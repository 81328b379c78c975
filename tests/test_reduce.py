import numpy as np
import pytest

from varkit.operators.moments import correlation_matrix, gram_matrix
from varkit.operators.qr import dependent_columns, r_factor
from varkit.operators.reduce import (
    backward_selection, centred_vif, correlation_clusters, ols_no_intercept,
    varclus, varclus_table, vif_reduction, vif_reduction_corr, vif_table,
)


def test_vif_fixture(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0)], "x1 double, x2 double")
    raw = dict(vif_table(df))
    assert raw["x1"] == pytest.approx(7.758621, rel=1e-6) and raw["x2"] == pytest.approx(7.758621, rel=1e-6)
    cen = dict(centred_vif(df))
    assert cen["x1"] == pytest.approx(1.5625) and cen["x2"] == pytest.approx(1.5625)


@pytest.fixture
def collinear(spark):
    rnd = np.random.default_rng(3)
    n = 300
    x1 = rnd.normal(size=n)
    x2 = rnd.normal(size=n)
    x4 = rnd.normal(size=n) + 5
    x3 = x1 + x2
    y = 2 * x1 - x2 + 0.5 * x4 + rnd.normal(scale=.1, size=n)
    rows = [tuple(float(v) for v in r) for r in zip(x1, x2, x3, x4, y)]
    return spark.createDataFrame(rows, "x1 double, x2 double, x3 double, x4 double, y double"), np.array(rows)


def test_gram_and_corr(collinear):
    df, a = collinear
    n, g = gram_matrix(df, ["x1", "x2", "x4"])
    x = a[:, [0, 1, 3]]
    assert n == len(a) and np.allclose(g, x.T @ x)
    cols, c = correlation_matrix(df, ["x1", "x2", "x4"])
    assert np.allclose(c, np.corrcoef(x.T))


def test_clusters_partition_columns(collinear):
    df, _ = collinear
    cl = correlation_clusters(df, cutoff=.5)
    members = sorted(v for m in cl.values() for v in m)
    assert members == ["x1", "x2", "x3", "x4", "y"]
    assert ["x4"] in cl.values()


def test_vif_reduction(collinear):
    df, a = collinear
    cols = ["x1", "x2", "x3", "x4"]
    dropped = vif_reduction(df, limit=2.5, cols=cols)
    left = [c for c in cols if c not in dropped]
    assert dropped and all(v <= 2.5 for _, v in vif_table(df.select(*left)))
    alt = vif_reduction_corr(df, limit=2.5, cols=cols)
    assert alt[0] == "x3"  # exactly collinear: dropped first
    assert dependent_columns(r_factor(df, ['x1', 'x2', 'x3'])) == [2]


def test_ols_matches_glr(spark, collinear):
    df, a = collinear
    res = {r["variable"]: r for r in ols_no_intercept(df, "y", ["x1", "x2", "x4"])}
    x, y = a[:, [0, 1, 3]], a[:, 4]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert [res[c]["coef"] for c in ("x1", "x2", "x4")] == pytest.approx(list(beta))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    v = VectorAssembler(inputCols=["x1", "x2", "x4"], outputCol="f").transform(df)
    m = GeneralizedLinearRegression(family="gaussian", fitIntercept=False, featuresCol="f", labelCol="y").fit(v)
    assert [res[c]["t"] for c in ("x1", "x2", "x4")] == pytest.approx(list(m.summary.tValues), rel=1e-6)


def test_backward_selection(spark):
    rnd = np.random.default_rng(8)
    n = 400
    x = rnd.normal(size=(n, 3))
    y = 3 * x[:, 0] + rnd.normal(size=n)
    rows = [tuple(float(v) for v in r) + (float(t),) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    dropped = backward_selection(df, "y", regression=True, alpha=.05)
    assert "a" not in dropped and len(dropped) >= 1
    yb = [(r[0], r[1], r[2], float(r[0] + rnd.normal() > 0)) for r in rows]
    dfb = spark.createDataFrame(yb, "a double, b double, c double, y double")
    dropped_b = backward_selection(dfb, "y", regression=False, alpha=.05)
    assert "a" not in dropped_b


def test_varclus(spark, collinear):
    df, _ = collinear
    rows = varclus_table(df.select("x1", "x2", "x3", "x4"), cutoff=.5)
    kept = varclus(df.select("x1", "x2", "x3", "x4"), cutoff=.5)
    assert "x4" in kept and len(kept) == len({r["cluster"] for r in rows})
    keep_all = varclus(df.select("x1", "x2", "x3", "x4"), cutoff=.5, maxdrop=0)
    assert sorted(keep_all) == ["x1", "x2", "x3", "x4"]
