"""Trend tables: worked fixtures and a brute-force model of the bucket rule."""

import math
import random

import pytest

from varkit.operators.trends import (
    binned_line, box_stats, categorical_trends, column_percent, graphical_tables, numeric_trends,
    trend_tables,
)

NAN = float("nan")


def _table(spark, values, labels=None):
    labels = labels or [i % 2 for i in range(len(values))]
    rows = [(i, None if v is None else float(v), labels[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, v double, label int")


def _buckets(df, b):
    out = numeric_trends(df, ["v"], "label", b).orderBy("bucket").collect()
    return [(r["bucket"], r["minima"], r["maxima"], r["counts"]) for r in out]


def test_trend_signed(spark):
    df = _table(spark, [-5, -3, -2, -2, 0, 0, 1, 2, 2, 2, 3, 8, None, NAN])
    assert _buckets(df, 3) == [(1, -5, -5, 1), (2, -3, -2, 3), (3, 0, 0, 2), (4, 1, 2, 4),
                               (5, 3, 3, 1), (6, 8, 8, 1), (7, None, None, 2)]


def test_trend_unit(spark):
    df = _table(spark, [-1, -.6, -.2, 0, .3, .8, 1])
    got = _buckets(df, 4)
    assert [g[1] for g in got] == [-1, -.6, -.2, 0, .3, .8, 1]
    assert all(g[3] == 1 for g in got)


def _brute(values, buckets):
    """Reference rule: per sign, equal-width inside [-1, 1], else row-number buckets
    with a value in the lowest bucket whose range contains it."""
    vals = [v for v in values if v is not None]
    neg = sorted(v for v in vals if v < 0)
    pos = sorted(v for v in vals if v > 0)
    nz = len(neg) + len(pos)
    keys = {}
    for side, part in ((0, neg), (2, pos)):
        if not part:
            continue
        b = max(1, math.ceil(buckets * len(part) / nz))
        wide = (-part[0] > 1) if side == 0 else (part[-1] > 1)
        if wide:
            step = math.ceil(len(part) / b)
            ranges = {}
            for rk, v in enumerate(part, start=1):
                k = rk // step + 1
                lo, hi = ranges.get(k, (v, v))
                ranges[k] = (min(lo, v), max(hi, v))
            for v in part:
                keys[v] = (side, min(k for k, (lo, hi) in ranges.items() if lo <= v <= hi))
        else:
            if side == 0:
                m = 10 ** math.ceil(math.log10(-part[0]))
                edges = sorted(-m / b * i for i in range(b, 0, -1))
                for v in part:
                    keys[v] = (0, next((i for i, e in enumerate(edges) if v <= e), len(edges)))
            else:
                m = 10 ** math.ceil(math.log10(part[-1]))
                edges = sorted(m / b * i for i in range(1, b))
                for v in part:
                    k = next((i for i, e in enumerate(edges) if v <= e), None)
                    keys[v] = (2, k if k is not None else (len(edges) if v < 1 else len(edges) + 1))
    for v in vals:
        if v == 0:
            keys[v] = (1, 0)
    groups = {}
    for v in vals:
        groups.setdefault(keys[v], []).append(v)
    out = sorted((min(g), max(g), len(g)) for g in groups.values())
    nulls = len(values) - len(vals)
    return out + ([(None, None, nulls)] if nulls else [])


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_trends_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = rnd.randint(20, 120)
    scale = rnd.choice([1.0, 30.0])
    values = [round(rnd.uniform(-scale, scale) * rnd.choice([0.2, 1.0]), rnd.choice([0, 1, 2])) for _ in range(n)]
    values += [None] * rnd.randint(0, 3) + [0.0] * rnd.randint(0, 4)
    b = rnd.choice([2, 3, 5, 10])
    got = [(r[1], r[2], r[3]) for r in _buckets(_table(spark, values), b)]
    assert got == _brute(values, b)
    assert sum(g[2] for g in got) == len(values)


def test_trends_bucketed_path(spark, bucketed):
    rnd = random.Random(11)
    values = [float(rnd.randint(-40, 90)) for _ in range(150)]
    got = [(r[1], r[2], r[3]) for r in _buckets(_table(spark, values), 6)]
    assert got == _brute(values, 6)


def test_categorical_trends_and_roles(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (2, "b", 2.0, 0), (3, "a", None, 1), (4, None, 4.0, 0)],
                               "id long, c string, v double, label int")
    cat = {r["category"]: (r["counts"], r["dep_sum"]) for r in categorical_trends(df, ["c"], "label").collect()}
    assert cat == {"a": (2, 2), "b": (1, 0), None: (1, 0)}
    num, cat2 = trend_tables(df, {"v": "N", "c": "C", "label": "L", "id": "x"}, 2)
    # positives 1, 2, 4 in two buckets of ceil(3/2) rows: {1}, {2, 4}; plus the NULL bucket
    assert num.count() == 3 and cat2.count() == 3


def test_plot_tables(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), str(i % 2), i % 2) for i in range(1, 21)],
                               "x double, y double, g string, cls int")
    line = binned_line(df, "y", 4).where("variable = 'x'").orderBy("bucket").collect()
    assert [r["n"] for r in line] == [4, 5, 5, 5, 1] and line[0]["x_max"] == 4.0
    box = {r["group"]: r for r in box_stats(df, "y", regression=True).collect()}
    assert box["0"]["n"] == 10 and box["0"]["median"] == 1.0
    cp = column_percent(df.select("g", "cls"), "cls").collect()
    assert len(cp) == 4 and {(r["category"], r["dv"], r["count"]) for r in cp} == \
        {("0", "0", 10), ("0", "1", 0), ("1", "0", 0), ("1", "1", 10)}


def test_graphical_tables(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), str(i % 2), i % 2) for i in range(1, 21)],
                               "x double, y double, g string, cls int")
    reg = graphical_tables(df.drop("cls"), "y", regression=True)
    # 20 rows in 10 buckets of 2 rows: ranks 1..20 give buckets 1..11
    assert set(reg) == {"line", "box"} and reg["line"].where("variable = 'x'").count() == 11
    cls = graphical_tables(df.withColumn("cls", df.cls.cast("string")), "cls", regression=False)
    assert set(cls) == {"box", "column_percent"}
    assert {r["variable"] for r in cls["box"].collect()} == {"x", "y"}
