"""Order statistics of raw rows: bracket by a quantile sketch, then select.

:func:`order_statistics` finds the values at given positions of each group without ranking, sorting or
shuffling the rows:

1. one pass merges a quantile sketch per group (``percentile_approx``: Greenwald-Khanna, rank error at most
   rows / ``ACCURACY``) and reads a grid of ``GRID`` + 1 quantiles from it.  The grid values around a wanted
   position, widened by the error, bracket the value there;
2. a second pass puts every row into a segment, map-side, by binary search over its group's bracket ends:
   the open intervals between ends, and the ends themselves.  Rows are counted per segment; only inside a
   bracket are they counted per distinct value.  What is shuffled is one row per segment and task, and the
   distinct values inside the brackets, a few thousandths of the rows;
3. segment counts are exact, so they say which segment holds a position and how many rows precede it.  A
   position on a bracket end is answered at once; the others by a window over their bracket's distinct values.

A bracket expected to be larger than a bucket (:data:`varkit.operators.rank.ROWS_PER_BUCKET`) is not counted by
value but taken as the table of a next round, with a sketch of its own: each round narrows by ``GRID`` / 2.  The
same happens where a segment turns out larger than the sketch promised, so the answer never rests on the
sketch's bound.  A value held by a third of all rows is one row per task wherever it is.  Groups that fit a
bucket are counted by value at once.

The groups and positions are known to the driver: variables of a profile, cut points of a trend table.  Groups
in numbers that grow with the data are the task of :func:`varkit.operators.rank.select_positions`.
"""

from __future__ import annotations

import bisect
import math
from typing import Iterable, Mapping, NamedTuple, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varkit.functions.columns import qcol
from varkit.functions.search import with_count_less
from varkit.operators.rank import bucket_limit
from varkit.operators.summary import Scratch

#: Relative rank error of the sketch is 1 / ACCURACY; the grid has a quantile every 1 / GRID.
ACCURACY, GRID = 10_000, 1_000


class Statistic(NamedTuple):
    """The value at a position, the number of smaller rows, and the rows that hold the value."""

    value: float
    before: int
    rows: int


class _Cut(NamedTuple):
    """Bracket ends of a group, ascending, and for each open interval between them (the first below the first end,
    the last above the last) whether its rows are counted by value."""

    ends: list[float]
    by_value: list[bool]


def _brackets(grid: Sequence[float], rows: int, positions: Iterable[int], limit: int) -> _Cut:
    error = 3.0 / ACCURACY
    spans = []
    for p in sorted(set(positions)):
        lo, hi = math.floor((p / rows - error) * GRID), math.ceil(((p + 1) / rows + error) * GRID)
        spans.append((lo if lo > 0 else None, hi if hi < GRID else None))
    ends = sorted({grid[j] for span in spans for j in span if j is not None})
    by_value = [False] * (len(ends) + 1)
    for lo, hi in spans:
        expected = ((GRID if hi is None else hi) - (lo or 0)) / GRID * rows
        if expected <= limit:
            first = 0 if lo is None else bisect.bisect_left(ends, grid[lo]) + 1
            last = len(ends) if hi is None else bisect.bisect_left(ends, grid[hi])
            by_value[first:last + 1] = [True] * (last + 1 - first)
    return _Cut(ends, by_value)


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[tuple, Iterable[int]],
                     sizes: Mapping[tuple, int]) -> dict[tuple[tuple, int], Statistic]:
    """``{(group, position): Statistic}`` for 0-based positions among a group's non-NULL values, ascending.

    ``rows`` holds the group columns ``keys`` and the double column ``value`` (no NaN), one row per row.
    ``sizes`` gives the exact number of non-NULL values of each group; positions outside are left out.
    """
    keys = list(keys)
    base = rows.select(*[qcol(k) for k in keys], qcol(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys:
        base, keys = base.withColumn("_all", F.lit(0)), ["_all"]
        found = order_statistics(base, keys, "_v", {(0,): wanted.get((), ())}, {(0,): sizes.get((), 0)})
        return {((), p): s for (_, p), s in found.items()}
    todo = {g: sorted({p for p in ps if 0 <= p < sizes.get(g, 0)}) for g, ps in wanted.items()}
    todo = {g: ps for g, ps in todo.items() if ps}
    return _select(base, keys, todo, dict(sizes), 0) if todo else {}


def _select(base: DataFrame, keys: list[str], wanted: dict, sizes: dict, depth: int) -> dict:
    spark = base.sparkSession
    limit = bucket_limit(spark)
    fields = [base.schema[k] for k in keys]
    cuts = {g: _Cut([], [True]) for g in wanted}
    big = [g for g in wanted if sizes[g] > limit]
    if big:
        some = base
        if len(big) < len(wanted) or depth:
            some = base.join(F.broadcast(spark.createDataFrame(big, T.StructType(fields))), keys, "left_semi")
        points = [j / GRID for j in range(GRID + 1)]
        for r in some.groupBy(*keys).agg(F.percentile_approx("_v", points, ACCURACY).alias("_grid")).collect():
            g = tuple(r[k] for k in keys)
            cuts[g] = _brackets(r["_grid"], sizes[g], wanted[g], limit)
    table = spark.createDataFrame([(*g, *cuts[g]) for g in wanted], T.StructType(
        fields + [T.StructField("_ends", T.ArrayType(T.DoubleType())), T.StructField("_by_value", T.ArrayType(T.BooleanType()))]))
    most = max(len(c.ends) for c in cuts.values())
    x = base.join(F.broadcast(table), keys)
    x = with_count_less(x, "_ends", F.col("_v"), most, "_below")
    # even: an open interval; odd: one of the ends
    segment = f"_seg{depth}"
    on_end = F.coalesce(F.try_element_at("_ends", F.col("_below") + 1) == F.col("_v"), F.lit(False))
    x = x.withColumn(segment, 2 * F.col("_below") + on_end.cast("int"))
    listed = (F.col(segment) % 2 == 1) | F.try_element_at("_by_value", (F.col("_below") + 1).cast("int"))
    scratch = Scratch()
    try:
        cells = scratch.keep(x.groupBy(*keys, segment, F.when(listed, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_w")))
        totals: dict = {}
        for r in cells.groupBy(*keys, segment).agg(F.sum("_w").alias("n"), F.count("_v").alias("d")).collect():
            totals.setdefault(tuple(r[k] for k in keys), []).append((r[segment], r["n"], r["d"]))
        found, inside, deeper, below = {}, [], {}, {}
        for g, ps in wanted.items():
            start = 0
            for seg, n, d in sorted(totals.get(g, [])):
                for p in ps:
                    if start <= p < start + n:
                        if seg % 2:
                            found[g, p] = Statistic(cuts[g].ends[seg // 2], start, n)
                        elif d and (d <= limit or n >= sizes[g]):
                            inside.append((*g, seg, p, start))
                        else:
                            deeper.setdefault((*g, seg), []).append(p - start)
                            below[(*g, seg)] = (g, start, n)
                start += n
        if inside:
            at = spark.createDataFrame(inside, T.StructType(fields + [
                T.StructField(segment, T.IntegerType()), T.StructField("_pos", T.LongType()), T.StructField("_start", T.LongType())]))
            held = cells.join(F.broadcast(at.select(*keys, segment).distinct()), [*keys, segment], "left_semi")
            run = Window.partitionBy(*keys, segment).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
            held = held.withColumn("_before", F.coalesce(F.sum("_w").over(run), F.lit(0)))
            hits = held.join(F.broadcast(at), [*keys, segment]).withColumn("_before", F.col("_before") + F.col("_start"))
            for r in hits.where((F.col("_pos") >= F.col("_before")) & (F.col("_pos") < F.col("_before") + F.col("_w"))).collect():
                found[tuple(r[k] for k in keys), r["_pos"]] = Statistic(r["_v"], r["_before"], r["_w"])
    finally:
        scratch.release()
    if deeper:
        narrowed = x.select(*keys, segment, "_v").join(
            F.broadcast(spark.createDataFrame(list(deeper), T.StructType(fields + [T.StructField(segment, T.IntegerType())]))),
            [*keys, segment], "left_semi")
        for (g2, p), s in _select(narrowed, [*keys, segment], deeper, {g2: n for g2, (_, _, n) in below.items()}, depth + 1).items():
            g, start, _ = below[g2]
            found[g, p + start] = Statistic(s.value, s.before + start, s.rows)
    return found
