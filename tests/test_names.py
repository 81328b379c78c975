"""Any column name works (dots, spaces, dashes, backticks): no formula or SQL text is built."""

from varkit.operators.profile import profile
from varkit.operators.reduce import vif_table
from varkit.operators.treat import cap_floor, dummies
from varkit.operators.trends import categorical_trends, numeric_trends


def test_odd_column_names(spark):
    rows = [(float(i), float((i * 3) % 7), "ab"[i % 2], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "`a.b` double, `x y` double, `c-d` string, `la``bel` int")
    prof = {r["variable"]: r for r in profile(df, dv="a.b").collect()}
    assert prof["x y"]["count"] == 30 and prof["c-d"]["max_cat"] in ("a", "b")
    assert prof["a.b"]["assoc_value"] == 1.0
    tr = numeric_trends(df, ["a.b", "x y"], "la`bel", 3).collect()
    assert sum(r["counts"] for r in tr if r["variable"] == "a.b") == 30
    ct = categorical_trends(df, ["c-d"], "la`bel").collect()
    assert sorted(r["counts"] for r in ct) == [15, 15]
    assert cap_floor(df, "x y", 5.0, 1.0).agg({"`x y`": "max"}).collect()[0][0] == 5.0
    out, cats = dummies(df, "c-d")
    assert len(cats) == 1 and f"c-d_dum_{cats[0]}" in out.columns
    assert dict(vif_table(df, ["a.b", "x y"]))["x y"] > 1
