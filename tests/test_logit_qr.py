"""Triangular factors, logistic fits and what the selections make of them."""

import numpy as np
import pytest

from varkit.operators import logit, qr
from varkit.operators.reduce import backward_selection, backward_steps, vif_rounds


def frame(spark, a, names):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in a], ", ".join(f"{n} double" for n in names)).repartition(7)


def test_factor_equals_numpy_and_keeps_the_ninth_digit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 4)) * [1, 1e4, 1e-3, 1]
    x[:, 3] = x[:, 0] + 1e-9 * rng.normal(size=900)  # condition about 1e9: no combination, as numpy's QR sees it
    names = ["a", "b", "c", "d"]
    r = qr.r_factor(frame(spark, x, names), names)
    want = np.linalg.qr(x, mode="r")
    assert np.allclose(np.abs(r), np.abs(want), rtol=1e-6, atol=1e-13)
    assert qr.dependent_columns(r) == [] and qr.pivot_shares(r)[3] == pytest.approx(1e-9, rel=0.2)
    x[:, 3] = 2 * x[:, 0] - 3 * x[:, 2]
    assert qr.dependent_columns(qr.r_factor(frame(spark, x, names), names)) == [3]


def test_factor_of_few_rows_zeros_and_nothing(spark):
    df = frame(spark, np.array([[1.0, 2.0, 0.0], [2.0, 1.0, 0.0]]), ["a", "b", "z"])
    assert qr.dependent_columns(qr.r_factor(df, ["a", "b", "z"])) == [2]
    assert qr.dependent_columns(qr.r_factor(df, ["z", "a", "a"])) == [0, 2]
    assert not qr.r_factor(df.where("false"), ["a", "b"]).any()


def labelled(n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0.2, 0, 0]
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.01 * x[:, 1])))
    return x, (rng.random(n) < p).astype(float)


def test_fit_equals_the_glm(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    x, y = labelled()
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "c", "y"])
    fit = logit.logit_fit(df, ["a", "b", "c"], "y")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(df)
    s = GeneralizedLinearRegression(family="binomial", fitIntercept=False, featuresCol="f", labelCol="y", tol=1e-12, maxIter=60).fit(v)
    assert list(fit.coef) == pytest.approx(list(s.coefficients), rel=1e-6)
    assert list(fit.z) == pytest.approx(list(s.summary.tValues), rel=1e-5) and list(fit.p) == pytest.approx(list(s.summary.pValues), rel=1e-4, abs=1e-12)
    warm = logit.logit_fit(df, ["a", "b", "c"], "y", start=fit.coef)
    assert warm.steps <= 1 and list(warm.p) == pytest.approx(list(fit.p), rel=1e-6)


def test_collinear_columns_are_dropped_first(spark):
    x, y = labelled()
    df = frame(spark, np.column_stack([x[:, 0], 2 * x[:, 0], x[:, 2], y]), ["a", "a2", "c", "y"])
    fit = logit.logit_fit(df, ["a", "a2", "c"], "y")
    assert np.isnan(fit.p[1]) and not np.isnan(fit.p[[0, 2]]).any()
    alone = logit.logit_fit(df, ["a", "c"], "y")
    assert list(fit.coef[[0, 2]]) == pytest.approx(list(alone.coef), rel=1e-8)
    assert backward_selection(df, "y", regression=False)[0] == "a2"


def test_separated_labels_are_named(spark):
    x, _ = labelled()
    df = frame(spark, np.column_stack([x, x[:, 0] > 0]), ["a", "b", "c", "y"])
    with pytest.raises(ArithmeticError, match="separates"):
        logit.logit_fit(df, ["a", "b", "c"], "y")


def test_steps_of_the_selections(spark):
    x, y = labelled()
    df = frame(spark, np.column_stack([x, y]), ["a", "b", "c", "y"]).selectExpr("*", "CASE WHEN a > 0 THEN NULL ELSE 'x' END AS note")
    steps = backward_steps(df, "y", regression=False)
    assert [s[0] for s in steps] == backward_selection(df, "y", regression=False) and all(p > 0.05 for *_, p in steps)
    a = np.column_stack([x, x[:, 0] + 0.3 * y])
    rounds = vif_rounds(frame(spark, a, ["a", "b", "c", "d"]), 2.5, centred=True)
    corr = np.corrcoef(a.T)
    top = np.diag(np.linalg.inv(corr))
    assert rounds[0][1] == pytest.approx(top.max(), rel=1e-6)
