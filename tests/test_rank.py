"""Exact ranks: compare with brute force, with and without range buckets."""

import random

import pytest
from pyspark.sql import functions as F

from varkit.functions.search import with_count_less
from varkit.operators.rank import select_positions, with_positions


def _brute_select(rows, positions):
    """rows: list of (group, value, weight); value at weighted 0-based position."""
    out = {}
    groups = {}
    for g, v, w in rows:
        groups.setdefault(g, []).append((v, w))
    for g, items in groups.items():
        seq = []
        for v, w in sorted(items):
            seq += [v] * w
        for p in positions:
            if p < len(seq):
                out[(g, p)] = seq[p]
    return out


@pytest.mark.parametrize("force", [False, True])
def test_select_positions_numeric(spark, force):
    from varkit.operators.rank import CONF_ROWS_PER_BUCKET
    if force:
        spark.conf.set(CONF_ROWS_PER_BUCKET, "4")
    try:
        rnd = random.Random(5)
        rows = []
        for g in ("a", "b", "c"):
            vals = rnd.sample(range(-200, 200), 60)
            rows += [(g, float(v), rnd.randint(1, 5)) for v in vals]
        df = spark.createDataFrame(rows, "g string, v double, w long")
        positions = [0, 1, 7, 50, 100, 149, 150, 151, 170, 1000]
        tg = spark.createDataFrame([(g, p) for g in "abc" for p in positions], "g string, _pos long")
        got = {(r["g"], r["_pos"]): r["v"] for r in
               select_positions(df, ["g"], "v", "w", tg).collect()}
        assert got == _brute_select(rows, positions)
    finally:
        spark.conf.unset(CONF_ROWS_PER_BUCKET)


def test_select_positions_strings(spark, bucketed):
    rnd = random.Random(9)
    cats = [f"k{rnd.randint(0, 10 ** 6):07d}" for _ in range(200)]
    cats = sorted(set(cats))
    rows = [("x", c, 1) for c in cats]
    df = spark.createDataFrame(rows, "g string, v string, w long")
    positions = [0, 3, 50, 99, len(cats) - 1]
    tg = spark.createDataFrame([("x", p) for p in positions], "g string, _pos long")
    got = {r["_pos"]: r["v"] for r in select_positions(df, ["g"], "v", None, tg).collect()}
    assert got == {p: cats[p] for p in positions}


def test_with_positions_ties_broken_by_key(spark, bucketed):
    rnd = random.Random(3)
    rows = [(i, float(rnd.randint(0, 9))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, v double")
    got = {r["id"]: r["_pos"] for r in
           with_positions(df, [], ["v", "id"]).collect()}
    want = {i: p for p, (v, i) in enumerate(sorted((v, i) for i, v in rows))}
    assert got == want


def test_binary_search(spark):
    df = spark.createDataFrame([(v,) for v in [-1.0, 0.0, 0.5, 1.0, 2.5, 3.0, 9.0, None]], "v double")
    df = df.withColumn("b", F.array(*[F.lit(x) for x in [0.0, 1.0, 1.0, 2.0, 3.0]]))
    got = {r["v"]: (r["lt"], r["le"]) for r in
           with_count_less(with_count_less(df, "b", F.col("v"), 5, "lt"), "b", F.col("v"), 5, "le",
                           or_equal=True).collect()}
    assert got[-1.0] == (0, 0) and got[0.0] == (0, 1) and got[1.0] == (1, 3)
    assert got[2.5] == (4, 4) and got[3.0] == (4, 5) and got[9.0] == (5, 5) and got[None] == (0, 0)


def test_one_value_spans_many_buckets(spark):
    """A value in a third of the rows is cut by the second order column; no bucket grows past the limit's double."""
    from varkit.operators import rank
    rnd = random.Random(8)
    rows = [(i, 7.0 if i % 3 == 0 else rnd.uniform(0, 20)) for i in range(9000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double").repartition(6).withColumn("_grp", F.lit(0))
    cut, several = rank._range_buckets(df, ["_grp"], ["v", "id"], 100)
    sizes = [r["count"] for r in cut.groupBy("_rb").count().collect()]
    assert several and sum(sizes) == 9000 and max(sizes) < 200
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, "100")
    try:
        got = {r["id"]: r["_pos"] for r in with_positions(df, [], ["v", "id"]).collect()}
    finally:
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    assert got == {i: p for p, (v, i) in enumerate(sorted((v, i) for i, v in rows))}


def test_buckets_are_cut_again_until_they_fit(spark, monkeypatch):
    """With few boundaries per level the second and third level do the rest: there is no largest number of buckets."""
    from varkit.operators import rank
    monkeypatch.setattr(rank, "SPLITS", 6)
    rnd = random.Random(2)
    rows = [(i, float(rnd.randint(0, 40))) for i in range(3000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "id long, v double")
    cut, _ = rank._range_buckets(df.withColumn("_grp", F.lit(0)), ["_grp"], ["v", "id"], 20)
    assert max(r["count"] for r in cut.groupBy("_rb").count().collect()) <= 60
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, "20")
    try:
        got = {r["id"]: r["_pos"] for r in with_positions(df, [], ["v", "id"]).collect()}
    finally:
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    assert got == {i: p for p, (_, _, i) in enumerate(sorted((v is not None, v or 0, i) for i, v in rows))}
    # rows equal in every order column can't be cut, and don't loop
    same = spark.createDataFrame([(1.0,)] * 300, "v double").withColumn("_grp", F.lit(0))
    assert rank._range_buckets(same, ["_grp"], ["v"], 10)[0].select("_rb").distinct().count() == 1


@pytest.mark.parametrize("limit,grid", [(250_000, 1000), (50, 1000), (50, 10), (3, 4)])
def test_order_statistics_by_brackets(spark, monkeypatch, limit, grid):
    """Small limits send brackets through further rounds; a coarse grid makes the first brackets wide."""
    from varkit.operators import brackets, rank
    monkeypatch.setattr(brackets, "GRID", grid)
    rnd = random.Random(4)
    data = {("a",): [7.0] * 700 + [rnd.uniform(-5, 50) for _ in range(1400)], ("b",): [float(rnd.randint(0, 5)) for _ in range(900)],
            ("c",): [rnd.gauss(0, 1) for _ in range(60)], ("d",): [float("inf")] * 80 + [-0.0, 0.0] * 20}
    df = spark.createDataFrame([(g[0], v) for g, vs in data.items() for v in vs] + [("a", None), ("z", None)], "g string, v double").repartition(5)
    want = {g: [0, 1, len(v) // 100, len(v) // 3, len(v) // 2, len(v) - 1, len(v)] for g, v in data.items()} | {("z",): [0]}

    def brute(vs, p):
        v = sorted(vs)[p]
        return brackets.Statistic(v, sum(x < v for x in vs), sum(x == v for x in vs))
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, str(limit))
    try:
        got = brackets.order_statistics(df, ["g"], "v", want, {g: len(v) for g, v in data.items()} | {("z",): 0})
    finally:
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    assert got == {(g, p): brute(data[g], p) for g, ps in want.items() for p in ps if g in data and p < len(data[g])}


def test_brackets_shuffle_a_small_part(spark):
    """The second pass counts by value inside the brackets only: the kept table is far smaller than the distinct values."""
    from varkit.operators import brackets, rank
    from varkit.operators.summary import Scratch
    kept, keep = [], Scratch.keep
    n = 200_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("v"))
    spark.conf.set(rank.CONF_ROWS_PER_BUCKET, "5000")
    try:
        Scratch.keep = lambda self, frame: kept.append(keep(self, frame)) or kept[-1]
        got = brackets.order_statistics(df, [], "v", {(): [0, n // 2, n - 1]}, {(): n})
        rows = [f.count() for f in kept]
    finally:
        Scratch.keep = keep
        spark.conf.unset(rank.CONF_ROWS_PER_BUCKET)
    assert [got[(), p].value for p in (0, n // 2, n - 1)] == [0.0, n / 2, n - 1.0]
    assert sum(rows) < n / 50
