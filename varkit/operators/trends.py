"""Bucketed trend tables against a label, and plot-ready bivariate tables.

Numeric trends (per variable): negatives, zero and positives are bucketed
separately.  A side whose values lie within [-1, 1] gets equal-width buckets
(edges at multiples of a power of ten); otherwise it gets equal-frequency
buckets where a value belongs to the *lowest* bucket whose row-number range
contains it, i.e. bucket = floor(rank_first / rows_per_bucket) + 1 with
rank_first the 1-based row number of the first occurrence of the value.  The
final buckets are numbered in value order with the missing bucket last.

Plan: one long table for all variables; bucket thresholds are a handful of exact
order statistics per variable (:func:`varkit.operators.brackets.order_statistics`);
bucket assignment is then a map-side binary search; one aggregate builds the table.  No global sort, no
per-variable job, no distinct-value collect.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from varkit.functions.columns import (
    category_value, numeric_value, numerical_categorical_division, qcol, roles_from_header,
    split_roles, to_long,
)
from varkit.functions.search import with_count_less
from varkit.operators.brackets import order_statistics
from varkit.operators.profile import distinct_values, exact_percentiles
from varkit.operators.rank import select_positions
from varkit.operators.summary import Scratch

NUMERIC_TREND_COLS = ["variable", "bucket", "minima", "var_sum", "maxima", "counts", "dep_sum",
                      "var_avg", "dep_avg"]
CATEGORICAL_TREND_COLS = ["variable", "category", "counts", "dep_sum", "dep_avg"]


def _side_params(n_side: int, n_nz: int, buckets: int, extreme: float, negative: bool) -> dict:
    """Bucket allocation of one sign side: count, equal-frequency or equal-width,
    rows per bucket or the equal-width edges, and the threshold positions."""
    b = max(1, math.ceil(buckets * n_side / n_nz)) if n_nz else 1
    eqf = n_side > 0 and (-extreme > 1 if negative else extreme > 1)
    out = dict(b=b, eqf=eqf, rows=0, edges=[], pos=[])
    if n_side == 0:
        return out
    if eqf:
        rows = math.ceil(n_side / b)
        out["rows"] = rows
        # threshold j (1 <= j <= n_side // rows) is passed by every value above the
        # value at 0-based position rows*j - 2; with rows = 1 the first is always passed
        out["pos"] = [rows * j - 2 for j in range(1, n_side // rows + 1) if rows * j - 1 >= 1]
    elif negative:
        m = 10.0 ** math.ceil(math.log10(-extreme))
        out["edges"] = [(-m / b) * i for i in range(b, 0, -1)]
    else:
        m = 10.0 ** math.ceil(math.log10(extreme))
        out["edges"] = [(m / b) * i for i in range(1, b)]
    return out


def numeric_trends(df: DataFrame, numericals: Sequence[str], label: str, buckets: int) -> DataFrame:
    """Bucketed trend table ``variable, bucket, minima, var_sum, maxima, counts,
    dep_sum, var_avg, dep_avg`` for the numeric columns against ``label``.

    Jobs: a one-row-per-variable summary, the exact thresholds by brackets, the final aggregate, which
    combines map-side to a row per bucket.  No distinct value is shuffled outside the brackets.
    """
    numericals = list(numericals)
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    spark = df.sparkSession
    scratch = Scratch()
    try:
        long = to_long(df, numericals, extra={"_y": qcol(label)})
        nn = long.where(F.col("value").isNotNull())
        summary = nn.groupBy("variable").agg(
            F.count(F.when(F.col("value") < 0, 1)).alias("n_neg"), F.count(F.when(F.col("value") == 0, 1)).alias("n_zero"),
            F.count(F.when(F.col("value") > 0, 1)).alias("n_pos"),
            F.min("value").alias("vmin"), F.max("value").alias("vmax")).collect()
        params, targets = {}, []
        for r in summary:
            nz = r["n_neg"] + r["n_pos"]
            neg = _side_params(r["n_neg"], nz, buckets, r["vmin"], True)
            pos = _side_params(r["n_pos"], nz, buckets, r["vmax"], False)
            params[r["variable"]] = (neg, pos)
            targets += [(r["variable"], "neg", p) for p in neg["pos"]]
            off = r["n_neg"] + r["n_zero"]
            targets += [(r["variable"], "pos", off + p) for p in pos["pos"]]
        thr: dict = {}
        if targets:
            sizes = {(r["variable"],): r["n_neg"] + r["n_zero"] + r["n_pos"] for r in summary}
            wanted: dict = {}
            for v, _, p in targets:
                wanted.setdefault((v,), []).append(p)
            at = order_statistics(nn, ["variable"], "value", wanted, sizes)
            for v, side, p in targets:
                thr.setdefault((v, side), []).append(at[(v,), p].value)
        meta_rows = []
        for v, (neg, pos) in params.items():
            neg_arr = sorted(thr.get((v, "neg"), [])) if neg["eqf"] else neg["edges"]
            pos_arr = sorted(thr.get((v, "pos"), [])) if pos["eqf"] else pos["edges"]
            meta_rows.append((v, neg["eqf"], pos["eqf"], int(neg["rows"]), int(pos["rows"]),
                              [float(a) for a in neg_arr], [float(a) for a in pos_arr]))
        meta = spark.createDataFrame(meta_rows, "variable string, neg_eqf boolean, pos_eqf boolean, "
                                                "rows_neg long, rows_pos long, neg_arr array<double>, "
                                                "pos_arr array<double>")
        x = nn.join(F.broadcast(meta), "variable", "inner")  # one row per variable
        is_neg, is_pos = F.col("value") < 0, F.col("value") > 0
        x = x.withColumn("_arr", F.when(is_neg, F.col("neg_arr")).when(is_pos, F.col("pos_arr")))
        x = with_count_less(x, "_arr", F.col("value"), int(buckets) + 2, "_k")
        side_bucket = (F.when(is_neg & F.col("neg_eqf"),
                              1 + F.col("_k") + (F.col("rows_neg") == 1).cast("int"))
                        .when(is_neg, 1 + F.col("_k"))
                        .when(is_pos & F.col("pos_eqf"),
                              1 + F.col("_k") + (F.col("rows_pos") == 1).cast("int"))
                        .when(is_pos, 1 + F.col("_k") + (F.col("value") == 1).cast("int"))
                        .otherwise(0))
        side = F.when(is_neg, 0).when(is_pos, 2).otherwise(1)
        x = x.withColumn("_side", side).withColumn("_sb", side_bucket)
        agg = x.groupBy("variable", "_side", "_sb").agg(
            F.min("value").alias("minima"), F.sum("value").alias("var_sum"), F.max("value").alias("maxima"),
            F.count(F.lit(1)).alias("counts"), F.sum("_y").alias("dep_sum"))
        none = F.lit(None).cast("double")
        nulls = long.where(F.col("value").isNull()).groupBy("variable").agg(
            F.count(F.lit(1)).alias("counts"), F.sum("_y").alias("dep_sum")).select(
            "variable", F.lit(3).alias("_side"), F.lit(0).alias("_sb"), none.alias("minima"), none.alias("var_sum"), none.alias("maxima"), "counts", "dep_sum")
        out = agg.unionByName(nulls)
        w = Window.partitionBy("variable").orderBy(F.col("minima").asc_nulls_last(), "_side", "_sb")
        out = (out.withColumn("bucket", F.row_number().over(w).cast("long"))
                  .withColumn("var_avg", F.col("var_sum") / F.col("counts"))
                  .withColumn("dep_avg", F.col("dep_sum") / F.col("counts")))
        return scratch.finish(out.select(*NUMERIC_TREND_COLS))
    finally:
        scratch.release()


def categorical_trends(df: DataFrame, categoricals: Sequence[str], label: str) -> DataFrame:
    """``variable, category, counts, dep_sum, dep_avg`` per category (NULL is a category)."""
    long = to_long(df, list(categoricals), kind="categorical", extra={"_y": qcol(label)})
    out = long.groupBy("variable", F.col("value").alias("category")).agg(
        F.count(F.lit(1)).alias("counts"), F.sum("_y").alias("dep_sum"))
    return out.withColumn("dep_avg", F.col("dep_sum") / F.col("counts")).select(*CATEGORICAL_TREND_COLS)


def trend_tables(df: DataFrame, header, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both trend tables from a role declaration (N numeric, C categorical, L label)."""
    numericals, categoricals, label = split_roles(roles_from_header(header))
    num = numeric_trends(df, numericals, label, buckets) if numericals else None
    cat = categorical_trends(df, categoricals, label) if categoricals else None
    return num, cat


# ------------------------------------------------------------------ plot tables
def binned_line(df: DataFrame, dv: str, buckets: int = 10, cols: Sequence[str] | None = None) -> DataFrame:
    """Line-plot table of ``dv`` against each numeric column: equal-frequency bins
    of the column (same lowest-bucket rule as the trends), with the bin's range,
    mean of the column, mean of dv and row count.  Columns
    ``variable, bucket, x_min, x_max, x_avg, dv_avg, n``."""
    num = [c for c in numerical_categorical_division(df, cols)[0] if c != dv]
    long = to_long(df, num, extra={"_y": numeric_value(df, dv)})
    dist = (long.where(F.col("value").isNotNull()).groupBy("variable", "value")
                .agg(F.count(F.lit(1)).alias("_w"), F.sum("_y").alias("_ys"),
                     F.count("_y").alias("_yn")))
    st = dist.groupBy("variable").agg(F.sum("_w").alias("_n"))
    st = st.withColumn("_rows", F.ceil(F.col("_n") / F.lit(float(buckets))).cast("long"))
    jmax = F.floor(F.col("_n") / F.col("_rows")).cast("int")
    tg = (st.where(jmax >= 1).select("variable", "_rows", F.explode(F.sequence(F.lit(1), jmax)).alias("_j"))
            .where(F.col("_rows") * F.col("_j") - 1 >= 1)
            .select("variable", (F.col("_rows") * F.col("_j") - 2).alias("_pos")))
    sel = select_positions(dist.select("variable", "value", "_w"), ["variable"], "value", "_w", tg, pos="_pos")
    thr = sel.groupBy("variable").agg(F.array_sort(F.collect_list("value")).alias("_thr"))
    x = dist.join(F.broadcast(st.join(thr, "variable", "left")), "variable")
    x = with_count_less(x, "_thr", F.col("value"), int(buckets) + 2, "_k")
    x = x.withColumn("_b", 1 + F.col("_k") + (F.col("_rows") == 1).cast("int"))
    agg = x.groupBy("variable", "_b").agg(
        F.min("value").alias("x_min"), F.max("value").alias("x_max"),
        (F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("x_avg"),
        F.try_divide(F.sum("_ys"), F.sum("_yn")).alias("dv_avg"),
        F.sum("_w").alias("n"))
    w = Window.partitionBy("variable").orderBy("_b")
    return agg.withColumn("bucket", F.row_number().over(w).cast("long")).select(
        "variable", "bucket", "x_min", "x_max", "x_avg", "dv_avg", "n")


def box_stats(df: DataFrame, dv: str, regression: bool = True, cols: Sequence[str] | None = None) -> DataFrame:
    """Box-plot table per (variable, group): ``n, q1, median, q3, whisker_lo,
    whisker_hi, n_outliers`` (whiskers at 1.5 IQR, the usual box-plot rule).

    Regression: dv grouped by each categorical column.  Classification: each
    numeric column grouped by the dv classes.  NULL groups and values are left out.
    """
    num, cat = numerical_categorical_division(df, cols)
    if regression:
        cat = [c for c in cat if c != dv]
        long = to_long(df, cat, kind="categorical", extra={"_x": numeric_value(df, dv)})
        long = long.select("variable", F.col("value").alias("group"), F.col("_x").alias("x"))
    else:
        num = [c for c in num if c != dv]
        long = to_long(df, num, extra={"_g": category_value(df, dv)})
        long = long.select("variable", F.col("_g").alias("group"), F.col("value").alias("x"))
    long = long.where(F.col("group").isNotNull() & F.col("x").isNotNull())
    # one weighted row per distinct value serves the quartiles and the whiskers
    dist = distinct_values(long, ["variable", "group"], "x")
    q = exact_percentiles(long, ["variable", "group"], "x", (.25, .5, .75), dist=dist)
    qs = q.groupBy("variable", "group").agg(
        *[F.max(F.when(F.col("_pi") == i, F.col("_pv"))).alias(n) for i, n in enumerate(["q1", "median", "q3"])])
    iqr = F.col("q3") - F.col("q1")
    qs = qs.withColumn("_lo", F.col("q1") - 1.5 * iqr).withColumn("_hi", F.col("q3") + 1.5 * iqr)
    j = dist.join(qs, ["variable", "group"])
    inside = (F.col("x") >= F.col("_lo")) & (F.col("x") <= F.col("_hi"))
    out = j.groupBy("variable", "group", "q1", "median", "q3").agg(
        F.sum("_w").alias("n"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("_w"))).alias("n_outliers"))
    return out.select("variable", "group", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")


def column_percent(df: DataFrame, dv: str, cols: Sequence[str] | None = None) -> DataFrame:
    """dv x category table per categorical column, with every cell (zeros too) and
    the percentage of the category's rows: ``variable, category, dv, count, pct``.
    NULL is a level on both sides.  The cells stay in long form: the grid is the join of each
    variable's categories with its dv classes, so class names are only ever values."""
    cat = [c for c in numerical_categorical_division(df, cols)[1] if c != dv]
    long = to_long(df, cat, kind="categorical", extra={"_y": category_value(df, dv)})
    cells = long.groupBy("variable", F.col("value").alias("category"), F.col("_y").alias("dv")).agg(F.count(F.lit(1)).alias("_n"))
    rows = cells.select("variable", "category").distinct()
    classes = cells.select(F.col("variable").alias("_v"), F.col("dv").alias("_dv")).distinct()
    grid = rows.join(classes, F.col("variable") == F.col("_v")).select("variable", "category", F.col("_dv").alias("dv"))
    c = cells.toDF("_cv", "_cc", "_cd", "_n")
    full = grid.join(c, (F.col("variable") == F.col("_cv")) & F.col("category").eqNullSafe(F.col("_cc")) & F.col("dv").eqNullSafe(F.col("_cd")), "left")
    full = full.select("variable", "category", "dv", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))
    w = Window.partitionBy("variable", "category")
    return full.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(w))


def graphical_tables(df: DataFrame, dv: str, regression: bool = True,
                     cols: Sequence[str] | None = None, buckets: int = 10) -> dict[str, DataFrame]:
    """The four bivariate views as tables (dv itself is skipped):

    * regression: numeric columns -> ``line`` (:func:`binned_line`),
      categorical columns -> ``box`` (dv by category, :func:`box_stats`);
    * classification: numeric columns -> ``box`` (column by dv class),
      categorical columns -> ``column_percent`` (:func:`column_percent`).

    Only the parts with at least one column of that type are returned.
    """
    num, cat = numerical_categorical_division(df, cols)
    num = [c for c in num if c != dv]
    cat = [c for c in cat if c != dv]
    keep = lambda cs: list(dict.fromkeys(cs + [dv]))
    out: dict[str, DataFrame] = {}
    if regression:
        if num:
            out["line"] = binned_line(df.select(*[qcol(c) for c in keep(num)]), dv, buckets)
        if cat:
            out["box"] = box_stats(df.select(*[qcol(c) for c in keep(cat)]), dv, regression=True)
    else:
        if num:
            out["box"] = box_stats(df.select(*[qcol(c) for c in keep(num)]), dv, regression=False)
        if cat:
            out["column_percent"] = column_percent(df.select(*[qcol(c) for c in keep(cat)]), dv)
    return out
