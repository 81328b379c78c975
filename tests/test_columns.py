import math

from varkit.functions.columns import (
    fold_nan, numerical_categorical_division, pct_name, roles_from_header, split_roles, to_long,
)


def test_pct_names():
    assert [pct_name(p) for p in (.01, .05, .1, .5, .9, .95, .99)] == \
        ["p1", "p5", "p10", "p50", "p90", "p95", "p99"]
    assert pct_name(.29) == "p29"
    assert pct_name(.57) == "p57"
    assert pct_name(.005) == "p0_5"


def test_typing(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True, 3)], "i int, d double, s string, b boolean, l long")
    assert numerical_categorical_division(df) == (["i", "d", "l"], ["s", "b"])
    assert numerical_categorical_division(df, ["s", "l"]) == (["l"], ["s"])


def test_roles(spark):
    header = spark.createDataFrame([("N", "C", "L", "x", "L")], "a string, b string, y string, z string, w string")
    roles = roles_from_header(header)
    assert roles == {"a": "N", "b": "C", "y": "L", "w": "L"}
    assert split_roles(roles) == (["a"], ["b"], "y")


def test_fold_nan_and_long(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 3.0, None)], "id long, v double, s string")
    assert fold_nan(df).collect()[0]["v"] is None
    long = to_long(df, ["v", "id"], id_cols=["s"]).collect()
    got = sorted((r["variable"], r["value"]) for r in long if r["value"] is not None)
    assert got == [("id", 1.0), ("id", 2.0), ("v", 3.0)]
    assert sum(1 for r in long if r["value"] is None) == 1
    cat = to_long(df, ["s"], kind="categorical").collect()
    assert sorted((r["value"] is None) for r in cat) == [False, True]
    assert not any(isinstance(r["value"], float) and math.isnan(r["value"]) for r in long)
