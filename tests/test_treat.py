import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varkit.operators.treat import cap_floor, dummies, dummies_binary, dummies_sparse, smooth_tails


def test_tail_ramp(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "id long, x double")
    out = {r["id"]: r["x"] for r in smooth_tails(df, "x", "id", .5).collect()}
    assert out[100] == pytest.approx(99.03125) and out[0] == pytest.approx(1.875)
    assert all(out[i] == i for i in range(1, 100))
    high_only = {r["id"]: r["x"] for r in smooth_tails(df, "x", "id", .5, low=False).collect()}
    assert high_only[0] == 0.0 and high_only[100] == pytest.approx(99.03125)
    low_only = {r["id"]: r["x"] for r in smooth_tails(df, "x", "id", .5, high=False).collect()}
    assert low_only[0] == pytest.approx(1.875) and low_only[100] == 100.0
    with pytest.raises(ValueError):
        smooth_tails(df, "x", "id", 1.0)


def _sequential(values, alpha):
    """The recurrence as written (ascending over the tail above p99)."""
    import numpy as np
    x = sorted(values)
    p95, p99 = np.quantile(x, .95), np.quantile(x, .99)
    band = [v for v in x if p95 <= v <= p99]
    s = band[0]
    for v in band[1:]:
        s = alpha * v + (1 - alpha) * s
    out = []
    for v in x:
        if v > p99:
            s = alpha * v + (1 - alpha) * s
            out.append(s)
    return out


def test_long_tail_chain_blocks(spark, bucketed):
    import random
    rnd = random.Random(4)
    values = [rnd.expovariate(1.0) * 100 for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, x double")
    alpha = .003  # long memory: the chain crosses several blocks
    out = smooth_tails(df, "x", "id", alpha, low=False)
    import numpy as np
    p99 = np.quantile(values, .99)
    got = [r["x"] for r in out.join(df.withColumnRenamed("x", "orig"), "id")
           .where(F.col("orig") > p99).orderBy("orig").collect()]
    want = _sequential(values, alpha)
    assert got == pytest.approx(want, rel=1e-9)


def test_dummies(spark):
    cats = ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + [None]
    df = spark.createDataFrame(list(enumerate(cats)), "id long, c string")
    out, cols = dummies(df, "c")
    assert cols == ["a", "b", "c"]
    assert out.columns == ["id", "c", "c_dum_a", "c_dum_b", "c_dum_c"]
    null_row = out.where(F.col("c").isNull()).collect()[0]
    assert (null_row["c_dum_a"], null_row["c_dum_b"], null_row["c_dum_c"]) == (0, 0, 0)
    assert out.agg(F.sum("c_dum_a")).collect()[0][0] == 4


def test_dummies_binary(spark):
    cats = ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + [None]
    df = spark.createDataFrame(list(enumerate(cats)), "id long, c string")
    out, conv = dummies_binary(df, "c")
    assert [(r["category"], int(r["digits"])) for r in conv.orderBy("code").collect()] == [("a", 0), ("b", 1), ("c", 10), (None, 11)]
    bits = {r["c"]: (r["c_dum_0"], r["c_dum_1"], r["c_dum_2"]) for r in out.collect()}
    assert bits == {"a": (0, 0, 0), "b": (1, 0, 0), "c": (0, 1, 0), None: (0, 0, 0)}


@pytest.mark.parametrize("hot", [10**6, 100])
def test_many_categories_and_a_hot_one(spark, monkeypatch, hot):
    """Codes of thousands of categories from range cuts and joins, a third of the rows in one category."""
    from varkit.operators import rank, treat
    monkeypatch.setattr(treat, "HOT_ROWS", hot)
    rnd = random.Random(3)
    cats = ["hot"] * 2000 + [f"k{rnd.randint(0, 2500)}" for _ in range(4000)] + [None] * 40
    rnd.shuffle(cats)
    df = spark.createDataFrame(list(enumerate(cats)), "id long, c string").repartition(4)
    count = {}
    for c in cats:
        count[c] = count.get(c, 0) + 1
    order = sorted(count, key=lambda c: (-count[c], c is None, c or ""))
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, "200")
    try:
        out, codes = dummies_binary(df, "c")
        assert [r["category"] for r in codes.orderBy("code").collect()] == order
        rows = out.collect()
        sparse, _ = dummies_sparse(df, "c")
        vectors = {r["id"]: r["c_dum"] for r in sparse.collect()}
    finally:
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    digits = len(bin(len(order))) - 2
    assert len(rows) == len(cats) and len(vectors) == len(cats)
    for r in rows:
        code = order.index(r["c"]) if r["c"] is not None else 0
        assert sum(r[f"c_dum_{j}"] << j for j in range(digits)) == code
        v = vectors[r["id"]]
        assert v.size == len(order) - 1
        assert list(v.indices) == ([] if r["c"] is None or r["c"] == order[-1] else [order.index(r["c"])])


def test_one_category_and_no_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "c string")
    for frame, n in ((df.where("c = 'a'"), 2), (df.where("c IS NULL"), 1), (df.where("c = 'z'"), 0)):
        out, _ = dummies_sparse(frame, "c")
        assert [r["c_dum"].numNonzeros() for r in out.collect()] == [0] * n
        assert dummies(frame, "c")[1] == [] and dummies_binary(frame, "c")[0].count() == n


def test_cap_floor(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, -3.0), (4, 100.0)], "id long, x double")
    assert [r["x"] for r in cap_floor(df, "x", 10.0, 0.0).orderBy("id").collect()] == [5.0, None, 0.0, 10.0]
    # b > a: capping runs first, flooring then lifts everything below b
    assert [r["x"] for r in cap_floor(df, "x", 1.0, 2.0).orderBy("id").collect()] == [2.0, None, 2.0, 2.0]
    once = cap_floor(df, "x", 10.0, 0.0)
    assert once.orderBy("id").collect() == cap_floor(once, "x", 10.0, 0.0).orderBy("id").collect()
    assert [r["x"] for r in cap_floor(df, "x", 10.0, 0.0, low=False).orderBy("id").collect()] == \
        [5.0, None, -3.0, 10.0]


@pytest.mark.parametrize("alpha", [0.5, 1e-3, 1e-6])
def test_small_steps_and_a_hot_value_in_the_tail(spark, monkeypatch, alpha):
    """Tails in blocks of 20 rows, a value held by a third of the tail, equal to the recursion row by row."""
    from varkit.operators import rank, treat
    monkeypatch.setattr(treat, "BLOCK_ROWS", 20)
    rnd = random.Random(11)
    values = [round(rnd.gauss(0, 1), 3) for _ in range(9000)] + [9.0] * 40 + [-9.0] * 40 + [rnd.uniform(4, 20) for _ in range(60)]
    rows = list(enumerate(values))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, "25")
    try:
        got = {r["id"]: r["v"] for r in treat.smooth_tails(df, "v", "id", alpha).collect()}
    finally:
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    p1, p5, p95, p99 = np.quantile(values, [.01, .05, .95, .99])
    order = sorted((v, i) for i, v in rows)
    want = dict(rows)
    band = [v for v, _ in order if p95 <= v <= p99]
    state = band[0]
    for v in band[1:]:
        state = alpha * v + (1 - alpha) * state
    for v, i in order:
        if v > p99:
            want[i] = state = alpha * v + (1 - alpha) * state
    band = [v for v, _ in order if p1 <= v <= p5]
    state = band[-1]
    for v in reversed(band[2:]):
        state = alpha * v + (1 - alpha) * state
    for v, i in reversed(order):
        if v < p1:
            want[i] = state = alpha * v + (1 - alpha) * state
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9
