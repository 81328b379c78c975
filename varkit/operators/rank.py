"""Exact ranks without a global window.

``row_number() over (order by x)`` with no partition key runs on one task.  The
helpers here give the same exact answers with every step partitioned:

1. per group (for example per variable) count the rows: one small aggregate;
2. groups larger than ``rows_per_bucket`` are cut into ranges.  The boundaries are
   *composite*: tuples of all the order columns, compared lexicographically, so a
   value held by a third of all rows is cut by the tie-breaking column and spans as
   many buckets as it needs.  They come from a row sample that is gathered and thinned
   per group by an aggregate; a level places at most ``SPLITS`` of them per group, and
   buckets that are still too large are cut again with boundaries of their own;
3. every row gets its bucket by binary search over its group's boundaries
   (:func:`varkit.functions.search.with_count_less`); the bucket is a pure function
   of the order columns and of the pinned boundaries, so a recomputation after an
   executor loss gives the same bucket;
4. per (group, bucket) totals give bucket offsets (one row per bucket);
5. an ordinary window partitioned by (group, bucket) finishes the job.

There is no limit on the number of buckets: it is rows / ``rows_per_bucket``.

:func:`select_positions` (order statistics) only runs step 5 on the buckets that contain a wanted
position.  :func:`with_positions` gives every row its exact 0-based position.  Order statistics
of raw rows are found by :func:`varkit.operators.brackets.order_statistics` without any such cut.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varkit.functions.columns import qcol
from varkit.functions.search import with_count_less

ROWS_PER_BUCKET = 250_000
#: Boundaries that one level places in a group, and sampled rows per bucket to place them.
SPLITS = 1024
SAMPLES_PER_BUCKET = 32
# Session setting that overrides the rows per range bucket (tests use a small
# value to run the bucketed path on small tables).
CONF_ROWS_PER_BUCKET = "varkit.rank.rowsPerBucket"

_GROUP = "_grp"
_RB = "_rb"


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bucket_limit(spark: SparkSession, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return int(spark.conf.get(CONF_ROWS_PER_BUCKET, str(rows_per_bucket)))


def _with_group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn(_GROUP, F.lit(0)), [_GROUP]


def _order_key(order: Sequence[str]) -> Column:
    """What boundaries are made of: the order column, or a struct of them, which compares field by field."""
    return qcol(order[0]) if len(order) == 1 else F.struct(*[qcol(c).alias(f"o{i}") for i, c in enumerate(order)])


def _range_buckets(df: DataFrame, keys: list[str], order: Sequence[str], limit: int,
                   max_group_rows: int | None = None, group_rows: dict | None = None) -> tuple[DataFrame, bool]:
    """Add column ``_rb`` (range bucket within the group, monotone in ``order``); the flag says
    whether any group needed more than one bucket.

    ``max_group_rows`` is an upper bound on the rows of any group and ``group_rows`` of each group, when
    the caller knows them; where they show that every group fits one bucket no counting job runs.
    """
    one = df.withColumn(_RB, F.lit(0))
    if max_group_rows is not None and max_group_rows <= limit:
        return one, False
    big = ([(k, n) for k, n in group_rows.items() if n > limit] if group_rows is not None
           else _oversize(df, keys, limit))
    if not big:
        return one, False
    levels: list[str] = []
    while big:
        level = f"{_RB}{len(levels)}"
        df = _cut(df, keys + levels, order, limit, big, level)
        levels.append(level)
        if max(n for _, n in big) <= SPLITS * limit:
            break  # every group got all the boundaries it needs
        before, big = sum(n for _, n in big), _oversize(df, keys + levels, 2 * limit)
        if sum(n for _, n in big) >= before and len(levels) > 1:
            break  # rows equal in every order column can't be told apart
    rb = F.col(levels[0]) if len(levels) == 1 else F.struct(*levels)
    return df.withColumn(_RB, rb).drop(*levels), True


def _oversize(df: DataFrame, keys: list[str], limit: int) -> list[tuple[tuple, int]]:
    sizes = df.groupBy(*[qcol(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return [(tuple(r[k] for k in keys), r["_n"]) for r in sizes.collect()]


def _cut(df: DataFrame, keys: list[str], order: Sequence[str], limit: int, big: list[tuple[tuple, int]], out: str) -> DataFrame:
    """Add ``out``: the range of every row within its group, 0 in groups that are not ``big``.

    Rows are only sampled to place boundaries (bucket sizes are balanced up to sampling noise), never
    dropped from the data.  The sample of a group is sorted and thinned to its boundaries by an
    aggregate; the boundaries are collected, which pins them for every later use of the plan.
    """
    spark = _spark(df)
    fields = [df.schema[k] for k in keys]
    wanted = [(*k, min(SPLITS, math.ceil(n / limit)), n) for k, n in big]
    rate = spark.createDataFrame([(*w[:-1], min(1.0, SAMPLES_PER_BUCKET * w[-2] / w[-1])) for w in wanted], T.StructType(
        fields + [T.StructField("_cut_parts", T.IntegerType()), T.StructField("_cut_rate", T.DoubleType())]))
    key = _order_key(order)
    kept = key.isNotNull() if len(order) == 1 else F.lit(True)
    sample = df.join(F.broadcast(rate), keys).where((F.rand(17) < F.col("_cut_rate")) & kept)
    thin = sample.groupBy(*[qcol(k) for k in keys]).agg(F.max("_cut_parts").alias("_cut_parts"), F.array_sort(F.collect_set(key)).alias("_cut_sample"))
    step = F.greatest(F.lit(1), F.floor(F.size("_cut_sample") / F.col("_cut_parts"))).cast("int")
    bounds = thin.select(*keys, F.slice(F.filter("_cut_sample", lambda x, i: (i > 0) & (i % step == 0)), F.lit(1), F.col("_cut_parts")).alias("_cut_bounds"))
    pinned = bounds.collect()
    table = spark.createDataFrame(pinned, bounds.schema)
    size = max([len(r["_cut_bounds"]) for r in pinned], default=0)
    # a NULL in a composite bound counts as smallest, as in the windows' order
    cut = with_count_less(df.join(F.broadcast(table), keys, "left"), "_cut_bounds", key, size, out, or_equal=False)
    return cut.drop("_cut_bounds")


def _bucket_totals(df_rb: DataFrame, keys: list[str], weight: str | None, grouped: bool) -> DataFrame:
    """Per (group, bucket): total weight ``_tot`` and the weight of all earlier
    buckets ``_off``.  With real group keys the running sum is a window per
    group (one row per bucket).  Without keys it is summed up on the driver, so
    that no plan gathers into a single partition."""
    w = F.sum(qcol(weight)) if weight else F.count(F.lit(1))
    tot = df_rb.groupBy(*[qcol(k) for k in keys], F.col(_RB)).agg(w.cast("long").alias("_tot"))
    if grouped:
        win = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(_RB).rowsBetween(
            Window.unboundedPreceding, -1)
        return tot.withColumn("_off", F.coalesce(F.sum("_tot").over(win), F.lit(0)).cast("long"))
    rows = sorted((r[_RB], r["_tot"]) for r in tot.select(_RB, "_tot").collect())
    acc, local = 0, []
    for b, t in rows:
        local.append((0, b, int(t), acc))
        acc += t
    return _spark(df_rb).createDataFrame(local, T.StructType([
        T.StructField(_GROUP, T.IntegerType()), df_rb.schema[_RB], T.StructField("_tot", T.LongType()), T.StructField("_off", T.LongType())]))


def select_positions(dist: DataFrame, keys: Sequence[str], value: str, weight: str | None,
                     targets: DataFrame, *, pos: str = "_pos",
                     rows_per_bucket: int = ROWS_PER_BUCKET,
                     max_group_rows: int | None = None,
                     group_rows: dict | None = None) -> DataFrame:
    """Order statistics: for each target row, the ``value`` at 0-based position ``pos``.

    ``dist`` has one row per (keys, value) with an optional ``weight`` (a row
    stands for ``weight`` equal values).  ``targets`` is a small table
    ``(*keys, pos, ...)``; the result is ``targets`` plus ``value``, ``_before``
    (weight of smaller values) and ``_w`` for the row that holds the position.
    Targets outside ``[0, total)`` get no row.  ``group_rows`` maps each group's
    key tuple to (an upper bound of) its row count when the caller knows it.
    """
    keys = list(keys)
    had_keys = bool(keys)
    dist, keys = _with_group(dist, keys)
    if not had_keys:
        targets = targets.withColumn(_GROUP, F.lit(0))
    wcol = qcol(weight) if weight else F.lit(1)
    base = dist.select(*[qcol(k) for k in keys], qcol(value).alias("_val"),
                       wcol.cast("long").alias("_w"))
    rb, bucketed = _range_buckets(base, keys, ["_val"], bucket_limit(_spark(dist), rows_per_bucket), max_group_rows,
                                  group_rows if had_keys else None)
    if not bucketed:
        # every group fits one task: a plain window per group, no bucket offsets
        win = Window.partitionBy(*[qcol(k) for k in keys]).orderBy("_val").rowsBetween(
            Window.unboundedPreceding, -1)
        cand = rb.drop(_RB).withColumn("_before", F.coalesce(F.sum("_w").over(win), F.lit(0)))
        hit = (targets.join(cand, keys, "inner")
               .where((F.col(pos) >= F.col("_before")) & (F.col(pos) < F.col("_before") + F.col("_w"))))
        out = hit.withColumnRenamed("_val", value)
        return out.drop(_GROUP) if not had_keys else out
    totals = _bucket_totals(rb, keys, "_w", had_keys)
    # which bucket holds each target position (small x small)
    tb = (targets.join(totals, keys, "inner")
                 .where((F.col(pos) >= F.col("_off")) & (F.col(pos) < F.col("_off") + F.col("_tot"))))
    wanted = tb.select(*keys, _RB, "_off").distinct()
    cand = rb.join(wanted, keys + [_RB], "inner")
    win = Window.partitionBy(*[qcol(k) for k in keys], F.col(_RB)).orderBy("_val").rowsBetween(
        Window.unboundedPreceding, -1)
    cand = cand.withColumn("_before",
                           F.col("_off") + F.coalesce(F.sum("_w").over(win), F.lit(0)))
    hit = (tb.drop("_tot", "_off")
           .join(cand.drop("_off"), keys + [_RB], "inner")
           .where((F.col(pos) >= F.col("_before")) & (F.col(pos) < F.col("_before") + F.col("_w"))))
    out = hit.withColumnRenamed("_val", value).drop(_RB)
    if not had_keys:
        out = out.drop(_GROUP)
    return out


def with_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, out: str = "_pos",
                   rows_per_bucket: int = ROWS_PER_BUCKET, max_group_rows: int | None = None) -> DataFrame:
    """Every row gets its exact 0-based position within ``keys`` in the ascending order of the
    columns ``order`` (NULL first, NaN last).

    Buckets are cut in all order columns together, so rows that share the first value are spread over
    as many buckets as they fill.  Rows equal in every order column are interchangeable and share a bucket.
    """
    keys = list(keys)
    had_keys = bool(keys)
    df, keys = _with_group(df, keys)
    by = [qcol(c).asc() for c in order]
    rb, bucketed = _range_buckets(df, keys, order, bucket_limit(_spark(df), rows_per_bucket), max_group_rows)
    if not bucketed:
        win = Window.partitionBy(*[qcol(k) for k in keys]).orderBy(*by)
        res = rb.drop(_RB).withColumn(out, (F.row_number().over(win) - 1).cast("long"))
        return res.drop(_GROUP) if not had_keys else res
    totals = _bucket_totals(rb, keys, None, had_keys).select(*keys, _RB, "_off")
    rb = rb.join(totals, keys + [_RB], "left")
    win = Window.partitionBy(*[qcol(k) for k in keys], F.col(_RB)).orderBy(*by)
    res = rb.withColumn(out, F.col("_off") + F.row_number().over(win) - 1).drop("_off", _RB)
    if not had_keys:
        res = res.drop(_GROUP)
    return res
