"""Variable profile on a small mixed table with NULL, NaN, ties and a constant column."""

import math
from datetime import datetime

import numpy as np
import pytest

from varkit.functions.distributions import chi2_sf, f_sf, t_sf2
from varkit.operators.profile import profile

NAN = float("nan")


@pytest.fixture
def mixed(spark):
    rows = [
        (1, 3, 1.5, "a", True, datetime(2020, 1, 1), 10.0, 1),
        (2, 3, NAN, "b", False, datetime(2020, 1, 2), 12.0, 0),
        (3, None, 2.5, "a", None, datetime(2020, 1, 3), 9.0, 1),
        (4, 7, 2.5, None, True, None, 15.0, 0),
        (5, 1, -4.0, "c", True, datetime(2020, 1, 1), 11.0, 1),
        (6, 3, 8.0, "a", False, datetime(2020, 1, 5), 20.0, 0),
        (7, 9, 2.5, "b", True, datetime(2020, 1, 6), 7.0, 1),
        (8, 2, None, "c", True, datetime(2020, 1, 7), 13.0, 0),
    ]
    schema = ("id long, n_int int, n_dbl double, c_str string, c_bool boolean, ts timestamp, "
              "y double, y01 int")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("const", df.id * 0 + 5.0), rows


def _moments(x):
    x = np.asarray(x, float)
    m = x.mean()
    c = x - m
    m2, m3, m4 = (c ** 2).mean(), (c ** 3).mean(), (c ** 4).mean()
    return x.std(ddof=1), m3 / m2 ** 1.5, m4 / m2 ** 2


def test_numeric_rows(mixed):
    df, rows = mixed
    got = {r["variable"]: r for r in profile(df.drop("id")).collect()}
    vals = [r[2] for r in rows if r[2] is not None and not math.isnan(r[2])]
    r = got["n_dbl"]
    assert r["type"] == "numeric" and r["count"] == 6 and r["nmiss"] == 2
    assert r["missing_rate"] == pytest.approx(25.0)
    assert r["unique"] == 4
    std, skew, kurt = _moments(vals)
    assert r["std"] == pytest.approx(std) and r["skewness"] == pytest.approx(skew)
    assert r["kurtosis"] == pytest.approx(kurt)
    assert r["mean"] == pytest.approx(np.mean(vals))
    assert r["min"] == -4.0 and r["max"] == 8.0
    for p, name in [(.01, "p1"), (.05, "p5"), (.1, "p10"), (.5, "p50"), (.9, "p90"), (.95, "p95"),
                    (.99, "p99")]:
        assert r[name] == pytest.approx(float(np.quantile(vals, p)))
    assert r["mean-2sigma"] == pytest.approx(np.mean(vals) - 2 * std)
    assert r["mean+3sigma"] == pytest.approx(np.mean(vals) + 3 * std)
    c = got["const"]
    assert c["std"] == 0 and c["skewness"] is None and c["p50"] == 5.0 and c["unique"] == 1


def test_categorical_rows(mixed):
    df, _ = mixed
    got = {r["variable"]: r for r in profile(df.drop("id")).collect()}
    s = got["c_str"]
    # counts: a 3, b 2, c 2, NULL 1 -> ascending (1 NULL), (2 b), (2 c), (3 a)
    assert s["type"] == "categorical" and s["count"] == 7 and s["nmiss"] == 1 and s["unique"] == 3
    assert s["min_cat"] is None and s["max_cat"] == "a"
    # cumulative shares .125, .375, .625, 1.0
    assert s["p1_cat"] is None and s["p10_cat"] is None and s["p50_cat"] == "c" and s["p90_cat"] == "a"
    b = got["c_bool"]
    assert b["min_cat"] is None and b["max_cat"] == "true" and b["unique"] == 2
    assert got["ts"]["count"] == 7
    order = [r["variable"] for r in sorted(got.values(), key=lambda r: r["ord"])]
    assert order == ["n_int", "n_dbl", "y", "y01", "const", "c_str", "c_bool", "ts"]


def test_association_regression(mixed):
    df, rows = mixed
    got = {r["variable"]: r for r in profile(df.drop("id", "const"), dv="y").collect()}
    pairs = [(r[1], r[6]) for r in rows if r[1] is not None]
    x, y = np.array(pairs, float).T
    assert got["n_int"]["assoc_kind"] == "pearson_r"
    assert got["n_int"]["assoc_value"] == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got["y"]["assoc_value"] == pytest.approx(1.0)
    # ANOVA of y by c_str (NULL category dropped)
    groups = {}
    for r in rows:
        if r[3] is not None:
            groups.setdefault(r[3], []).append(r[6])
    allv = np.concatenate([np.array(v) for v in groups.values()])
    ssb = sum(len(v) * (np.mean(v) - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    d1, d2 = len(groups) - 1, len(allv) - len(groups)
    f = (ssb / d1) / (ssw / d2)
    a = got["c_str"]
    assert a["assoc_kind"] == "anova_p" and a["assoc_stat"] == pytest.approx(f)
    assert a["assoc_value"] == pytest.approx(f_sf(f, d1, d2))


def test_association_classification(mixed):
    df, rows = mixed
    got = {r["variable"]: r for r in profile(df.drop("id", "const", "y"), dv="y01", regression=False).collect()}
    pairs = [(r[1], r[7]) for r in rows if r[1] is not None]
    x, y = np.array(pairs, float).T
    r = np.corrcoef(x, y)[0, 1]
    f = r * r * (len(x) - 2) / (1 - r * r)
    a = got["n_int"]
    assert a["assoc_kind"] == "f_p" and a["assoc_stat"] == pytest.approx(f)
    assert a["assoc_value"] == pytest.approx(f_sf(f, 1, len(x) - 2))
    # chi-square of every dv x category cell (NULL a level, zero cells included)
    cells = {}
    for row in rows:
        cells[(row[3], row[7])] = cells.get((row[3], row[7]), 0) + 1
    cats, dvs = {k[0] for k in cells}, {k[1] for k in cells}
    obs = [cells.get((c, d), 0) for c in cats for d in dvs]
    e = sum(obs) / len(obs)
    stat = sum((o - e) ** 2 / e for o in obs)
    c = got["c_str"]
    assert c["assoc_kind"] == "chi2_uniform_p" and c["assoc_stat"] == pytest.approx(stat)
    assert c["assoc_value"] == pytest.approx(chi2_sf(stat, len(obs) - 1))
    assert got["y01"]["assoc_value"] is None


def test_distribution_tails_match_jvm(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    assert chi2_sf(33.333333333333336, 3) == pytest.approx(2.739211e-07, rel=1e-6)
    for x, d1, d2 in [(0.3, 2, 7), (3.0, 1, 40), (12.5, 5, 300)]:
        assert f_sf(x, d1, d2) == pytest.approx(1 - jvm.FDistribution(float(d1), float(d2)).cumulativeProbability(x),
                                                rel=1e-9, abs=1e-14)
    for t, d in [(0.5, 3), (2.1, 20), (-4.0, 100)]:
        want = 2 * (1 - jvm.TDistribution(float(d)).cumulativeProbability(abs(t)))
        assert t_sf2(t, d) == pytest.approx(want, rel=1e-9, abs=1e-14)
    for x, k in [(0.5, 1), (7.0, 4), (40.0, 30)]:
        assert chi2_sf(x, k) == pytest.approx(1 - jvm.ChiSquaredDistribution(float(k)).cumulativeProbability(x),
                                              rel=1e-9, abs=1e-14)


def test_profile_percentiles_bucketed(spark, bucketed, mixed):
    df, rows = mixed
    got = {r["variable"]: r for r in profile(df.select("n_dbl", "c_str")).collect()}
    vals = [r[2] for r in rows if r[2] is not None and not math.isnan(r[2])]
    assert got["n_dbl"]["p50"] == pytest.approx(float(np.quantile(vals, .5)))
    assert got["c_str"]["p50_cat"] == "c"


def test_profile_approx_mode(spark):
    import random
    rnd = random.Random(2)
    rows = [(float(rnd.randint(0, 1000)), rnd.choice("xyz")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v double, c string")
    exact = {r["variable"]: r for r in profile(df).collect()}
    approx = {r["variable"]: r for r in profile(df, exact=False).collect()}
    assert approx["v"]["count"] == exact["v"]["count"] and approx["v"]["mean"] == pytest.approx(exact["v"]["mean"])
    assert abs(approx["v"]["p50"] - exact["v"]["p50"]) <= 2
    assert abs(approx["v"]["unique"] - exact["v"]["unique"]) <= 0.05 * exact["v"]["unique"]
    assert approx["c"]["max_cat"] == exact["c"]["max_cat"]


def test_chi_square_counts_null_apart_from_any_string(spark):
    from varkit.operators.profile import profile
    rows = [(v, y) for v, y, n in [("\u0000null", "a", 4), (None, "a", 3), ("x", "b", 5), ("\u0000null", "b", 2)] for _ in range(n)]
    got = {r["variable"]: r for r in profile(spark.createDataFrame(rows, "v string, y string"), dv="y", regression=False).collect()}["v"]
    cells = np.array([4, 3, 5, 2, 0, 0], float)
    e = cells.sum() / 6
    assert got["assoc_df1"] == 5 and got["assoc_stat"] == pytest.approx(((cells - e) ** 2 / e).sum())


def test_distinct_values_of_wide_types(spark):
    from decimal import Decimal
    from varkit.operators.profile import profile
    big = 2**53
    rows = [(big, Decimal("1.10"), 1.5, 1), (big + 1, Decimal("1.1"), float("nan"), None), (None, None, None, 1), (big + 1, Decimal("2"), 1.5, 2)]
    df = spark.createDataFrame(rows, "l long, d decimal(20,5), x double, i int")
    assert {r["variable"]: r["unique"] for r in profile(df).collect()} == {"l": 2, "d": 2, "x": 1, "i": 2}
