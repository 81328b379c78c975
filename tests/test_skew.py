"""A value held by a third of all rows: results stay exact on the bucketed path."""

import random

import numpy as np
import pytest

from test_trends import _brute, _table
from varkit.operators.profile import profile
from varkit.operators.score import gains_table
from varkit.operators.trends import numeric_trends


def _hot_values(n=300, seed=6):
    rnd = random.Random(seed)
    vals = [7.0] * (n // 3) + [float(rnd.randint(-50, 200)) for _ in range(n - n // 3)]
    rnd.shuffle(vals)
    return vals


def test_hot_value_profile_and_trends(spark, bucketed):
    vals = _hot_values()
    df = _table(spark, vals)
    got = {r["variable"]: r for r in profile(df.select("v")).collect()}["v"]
    for p, name in [(.01, "p1"), (.1, "p10"), (.5, "p50"), (.9, "p90"), (.99, "p99")]:
        assert got[name] == pytest.approx(float(np.quantile(vals, p)))
    out = numeric_trends(df, ["v"], "label", 5).orderBy("bucket").collect()
    assert [(r["minima"], r["maxima"], r["counts"]) for r in out] == _brute(vals, 5)


def test_hot_score_deciles(spark, bucketed):
    vals = _hot_values(200)
    rows = [(i, v, i % 2, "s") for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "row_id long, event_prob double, target_flag int, snapshot string")
    table, _ = gains_table(df, "event_prob", "target_flag", "snapshot", "row_id")
    got = {r["bucket"]: r["counts"] for r in table.collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    step = 20
    want = {}
    for rank, _ in enumerate(order, start=1):
        want[rank // step + 1] = want.get(rank // step + 1, 0) + 1
    assert got == want
