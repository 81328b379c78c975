"""Empty and all-NULL inputs give empty or NULL results, never errors."""

import pytest

from varkit.operators.profile import profile
from varkit.operators.score import gains_table
from varkit.operators.treat import smooth_tails
from varkit.operators.trends import categorical_trends, numeric_trends


@pytest.mark.parametrize("rows,expect_trend", [([], 0), ([(1, None, None, 1), (2, None, None, 0)], 1)])
def test_empty_and_null_inputs(spark, rows, expect_trend):
    df = spark.createDataFrame(rows, "id long, v double, c string, label int")
    prof = {r["variable"]: r for r in profile(df.select("v", "c")).collect()}
    assert prof["v"]["p50"] is None and prof["v"]["count"] == 0
    assert len(profile(df.select("v", "c", "label"), dv="label", regression=False).collect()) == 3
    trend = numeric_trends(df, ["v"], "label", 5).collect()
    assert len(trend) == expect_trend and all(r["minima"] is None for r in trend)
    assert len(categorical_trends(df, ["c"], "label").collect()) == expect_trend
    assert smooth_tails(df, "v", "id").count() == len(rows)
    assert gains_table(df.fillna(0.0, ["v"]), "v", "label", "c", "id")[0].count() == len(rows)
