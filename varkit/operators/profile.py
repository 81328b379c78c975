"""Variable profile (one row per variable) and association with a target.

Numeric variables: count, missing, distinct count, std (ddof 1), population
skewness, raw kurtosis (m4/m2^2), mean, min, max, mean -/+ k sigma and exact
linear-interpolated percentiles.  Categorical variables: counts, missing,
distinct count and the categories at cumulative shares of the ascending
frequency list (least frequent as ``min_cat``, most frequent as ``max_cat``).

Plan: the variables are unpivoted to a long table so one aggregate covers all
of them.  Percentiles come from :func:`varkit.operators.brackets.order_statistics`:
a quantile sketch brackets every wanted position and only the values inside the brackets are
shuffled, never all distinct values, a per-variable global sort or a per-variable collect.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varkit.functions.columns import (
    category_value, numeric_value, numerical_categorical_division, pct_name, qcol,
    sigma_names, to_coded, to_long, variable_order,
)
from varkit.functions.distributions import chi2_sf, f_sf
from varkit.operators.brackets import order_statistics
from varkit.operators.rank import select_positions
from varkit.operators.summary import Scratch, wide_agg

DEFAULT_PERCENTILES = (.01, .05, .1, .5, .9, .95, .99)
DEFAULT_CV = (2, 3)


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation as numpy computes it (exact at both ends)."""
    d = b - a
    return F.when(t >= 0.5, b - d * (1 - t)).otherwise(a + d * t)


def exact_percentiles(long: DataFrame, keys: Sequence[str], value: str,
                      percentiles: Sequence[float], *, count_col: str = "_cnt",
                      counts: DataFrame | None = None,
                      max_group_rows: int | None = None,
                      dist: DataFrame | None = None,
                      group_rows: dict | None = None) -> DataFrame:
    """Exact percentiles (numpy 'linear') of ``value`` per ``keys``.

    Returns ``(*keys, _pi, _pv)``: percentile index and value.  NULL values are
    ignored.  Ties are pre-aggregated to one weighted row per distinct value.
    ``counts`` (``keys`` + ``count_col``: non-null rows per group) and
    ``max_group_rows`` may be passed when the caller already computed them.
    """
    keys = list(keys)
    if dist is None:
        dist = distinct_values(long, keys, value)
    if counts is None:
        counts = dist.groupBy(*[qcol(k) for k in keys]).agg(F.sum("_w").alias(count_col))
    items = []
    for i, p in enumerate(percentiles):
        h = F.lit(float(p)) * (F.col(count_col) - 1)
        lo = F.floor(h).cast("long")
        hi = F.least(lo + 1, F.col(count_col) - 1)
        items.append(F.struct(F.lit(i).alias("_pi"), F.lit(0).alias("_side"), lo.alias("_pos"),
                              (h - lo).alias("_frac")))
        items.append(F.struct(F.lit(i).alias("_pi"), F.lit(1).alias("_side"), hi.alias("_pos"),
                              (h - lo).alias("_frac")))
    targets = (counts.where(F.col(count_col) > 0)
               .select(*keys, F.explode(F.array(*items)).alias("_t")).select(*keys, "_t.*"))
    sel = select_positions(dist, keys, value, "_w", targets, pos="_pos", max_group_rows=max_group_rows,
                           group_rows=group_rows)
    pv = sel.groupBy(*keys, "_pi").agg(
        F.max(F.when(F.col("_side") == 0, qcol(value))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, qcol(value))).alias("_b"),
        F.max("_frac").alias("_t"))
    return pv.select(*keys, "_pi", lerp(F.col("_a"), F.col("_b"), F.col("_t")).alias("_pv"))


def distinct_values(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, non-null value) with its row count ``_w``."""
    return (long.where(qcol(value).isNotNull())
                .groupBy(*[qcol(k) for k in keys], qcol(value)).agg(F.count(F.lit(1)).alias("_w")))


def _wide_stats(df: DataFrame, num: list[str], cat: list[str],
                approx_percentiles: Sequence[float] | None = None, accuracy: int = 10_000,
                dv_y: Column | None = None) -> dict:
    """One pass, no reshaping: per-column moments for numerics, non-null counts
    for categoricals, and the row count.  A global aggregate (partial per
    partition), one small row back.  With ``approx_percentiles`` the
    percentiles and distinct counts come from mergeable sketches
    (``percentile_approx``, ``hll_sketch_agg``) in a pass each."""
    aggs = [(F.count(F.lit(1)).alias("_n"), "count")]
    for i, c in enumerate(num):
        x = numeric_value(df, c)
        aggs += [(F.count(x).alias(f"c{i}"), "count"), (F.stddev_samp(x).alias(f"s{i}"), "stddev"),
                 (F.skewness(x).alias(f"k{i}"), "skewness"), (F.kurtosis(x).alias(f"u{i}"), "kurtosis"),
                 (F.avg(x).alias(f"a{i}"), "avg"), (F.min(x).alias(f"l{i}"), "min"),
                 (F.max(x).alias(f"h{i}"), "max")]
    if dv_y is not None:
        aggs += _pair_aggs(df, num, dv_y)
    for i, c in enumerate(cat):
        aggs.append((F.count(category_value(df, c)).alias(f"q{i}"), "count"))
    out = wide_agg(df, aggs)
    if approx_percentiles is not None and num:
        # sketches are object aggregates, which switch off generated code for all that shares their
        # pass: the moments above, percentiles and distinct counts each take one of their own
        values = {i: numeric_value(df, c) for i, c in enumerate(num)}
        points = [float(p) for p in approx_percentiles]
        out.update(df.agg(*[F.percentile_approx(x, points, accuracy).alias(f"p{i}") for i, x in values.items()]).collect()[0].asDict())
        out.update(df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(14))).alias(f"d{i}")
                            for i, x in values.items()]).collect()[0].asDict())
    return out


def _pair_aggs(df: DataFrame, num: list[str], y: Column) -> list[tuple]:
    """Pairwise-complete moments of every numeric column with y (for Pearson r)."""
    aggs = []
    for i, c in enumerate(num):
        x = numeric_value(df, c)
        both = x.isNotNull() & y.isNotNull()
        xm, ym = F.when(both, x), F.when(both, y)
        aggs += [(F.count(xm).alias(f"an{i}"), "count"), (F.covar_samp(xm, ym).alias(f"ac{i}"), "covar"),
                 (F.stddev_samp(xm).alias(f"asx{i}"), "stddev"), (F.stddev_samp(ym).alias(f"asy{i}"), "stddev")]
    return aggs


_NUM_STATS_SCHEMA = ("variable string, count long, _n long, std double, skewness double, "
                     "kurtosis double, mean double, min double, max double")


def _numeric_part_approx(df: DataFrame, num: list[str], percentiles, cv, ws: dict) -> DataFrame:
    """Numeric rows from the single sketch pass: no shuffle at all."""
    spark = df.sparkSession
    names = [pct_name(p) for p in percentiles]
    rows = []
    for i, c in enumerate(num):
        ku = ws[f"u{i}"]
        pv = ws[f"p{i}"] or [None] * len(percentiles)
        rows.append((c, ws[f"c{i}"], ws["_n"], ws[f"s{i}"], ws[f"k{i}"],
                     None if ku is None else ku + 3.0, ws[f"a{i}"], ws[f"l{i}"], ws[f"h{i}"],
                     int(ws[f"d{i}"] or 0)) + tuple(None if v is None else float(v) for v in pv))
    schema = _NUM_STATS_SCHEMA + ", unique long, " + ", ".join(f"`{n}` double" for n in names)
    return _with_sigmas(spark.createDataFrame(rows, schema), cv)


def _unique_counts(df: DataFrame, num: list[str]) -> dict[str, int]:
    """Distinct non-missing values of every numeric column, by native value, in one scan and one shuffle of
    (column number, value): doubles tell apart all values of the narrower types, 64-bit integers stay what they
    are and decimals are compared in their exact string form."""
    kinds = [T.LongType, T.DecimalType]
    slots = [("d", "double"), ("l", "long"), ("s", "string")]
    used, items = set(), []
    for i, c in enumerate(num):
        kind = next((j + 1 for j, k in enumerate(kinds) if isinstance(df.schema[c].dataType, k)), 0)
        used.add(kind)
        value = numeric_value(df, c) if kind == 0 else qcol(c).cast(slots[kind][1])
        items.append(F.struct(F.lit(i).alias("i"), *[(value if j == kind else F.lit(None).cast(t)).alias(n) for j, (n, t) in enumerate(slots)]))
    names = [slots[j][0] for j in sorted(used)]
    x = df.select(F.explode(F.array(*items)).alias("x")).select("x.i", *[f"x.{n}" for n in names])
    x = x.where(" OR ".join(f"{n} IS NOT NULL" for n in names)).distinct()
    counted = x.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()
    return {num[r["i"]]: r["n"] for r in counted}


def percentile_positions(n: int, p: float) -> tuple[int, int, float]:
    """The two 0-based positions between which percentile ``p`` of ``n`` values lies, and how far along."""
    h = p * (n - 1)
    lo = math.floor(h)
    return lo, min(lo + 1, n - 1), h - lo


def bracketed_percentiles(rows: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float],
                          sizes: Mapping[tuple, int]) -> dict[tuple, list[float]]:
    """Exact percentiles (numpy 'linear') of groups known to the driver, from raw rows: ``{group: values}``.
    ``sizes`` gives each group's number of non-NULL values; groups without any are left out."""
    wanted = {g: [q for p in percentiles for q in percentile_positions(n, p)[:2]] for g, n in sizes.items() if n}
    at = order_statistics(rows, keys, value, wanted, sizes)
    out = {}
    for g in wanted:
        values = []
        for p in percentiles:
            lo, hi, t = percentile_positions(sizes[g], p)
            a, b = at[g, lo].value, at[g, hi].value
            values.append(b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
        out[g] = values
    return out


def _numeric_part(df: DataFrame, num: list[str], percentiles, cv, ws: dict) -> DataFrame:
    """Numeric rows, one per variable: moments from ``ws``, exact distinct counts, and percentiles from brackets."""
    names = [pct_name(p) for p in percentiles]
    unique = _unique_counts(df, num)
    pcts = bracketed_percentiles(to_coded(df, num), ["code"], "value", percentiles, {(i,): ws[f"c{i}"] for i in range(len(num))})
    rows = []
    for i, c in enumerate(num):
        ku = ws[f"u{i}"]
        rows.append((c, ws[f"c{i}"], ws["_n"], ws[f"s{i}"], ws[f"k{i}"], None if ku is None else ku + 3.0, ws[f"a{i}"], ws[f"l{i}"], ws[f"h{i}"],
                     unique.get(c, 0)) + tuple(pcts.get((i,), [None] * len(names))))
    schema = _NUM_STATS_SCHEMA + ", unique long, " + ", ".join(f"`{n}` double" for n in names)
    return _with_sigmas(df.sparkSession.createDataFrame(rows, schema), cv)


def _with_sigmas(out: DataFrame, cv: Sequence[int]) -> DataFrame:
    for dev in cv:
        lo, hi = sigma_names(dev)
        out = out.withColumn(lo, F.col("mean") - F.lit(float(dev)) * F.col("std"))
        out = out.withColumn(hi, F.col("mean") + F.lit(float(dev)) * F.col("std"))
    return out.withColumn("type", F.lit("numeric"))


def _categorical_part(df: DataFrame, cat: list[str], percentiles, ws: dict, scratch: Scratch,
                      dv_y: Column | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Category shares.  Order: frequency ascending, then category ascending,
    NULL last among equal frequencies (a fixed rule for the tie order).

    With ``dv_y`` (a numeric dv) the same grouping also yields the per-category
    moments of dv for the one-way ANOVA, returned as the second value."""
    spark = df.sparkSession
    stats = spark.createDataFrame([(c, ws[f"q{i}"], ws["_n"]) for i, c in enumerate(cat)],
                                  "variable string, count long, _n long")
    if dv_y is None:
        long = to_long(df, cat, kind="categorical")
        cnt = scratch.keep(long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c")))
        groups = None
    else:
        long = to_long(df, cat, kind="categorical", extra={"_y": dv_y})
        cnt = scratch.keep(long.groupBy("variable", "value").agg(
            F.count(F.lit(1)).alias("c"), *_group_moment_aggs("_y")))
        groups = cnt.where(F.col("value").isNotNull() & (F.col("_ng") > 0)).select(
            "variable", F.col("value").alias("_grp"), "_ng", "_mg", "_ssw")
    uniq = cnt.groupBy("variable").agg(F.count("value").alias("unique"))
    # Frequency levels: one row per distinct count value, at most sqrt(2n) per variable.
    levels = cnt.groupBy("variable", "c").agg(
        F.count(F.lit(1)).alias("m"),
        F.max(F.col("value").isNull().cast("int")).alias("has_null"))
    wl = Window.partitionBy("variable").orderBy("c")
    levels = (levels
              .withColumn("before", F.coalesce(F.sum(F.col("c") * F.col("m")).over(
                  wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("after", F.col("before") + F.col("c") * F.col("m"))
              .withColumn("_ra", F.row_number().over(wl))
              .withColumn("_rd", F.row_number().over(Window.partitionBy("variable").orderBy(F.col("c").desc())))
              .join(F.broadcast(stats.select("variable", "_n")), "variable"))
    # Every target (least / most frequent, each percentile) from one pass over the levels.
    items = [F.when(F.col("_ra") == 1, F.struct(F.lit("min_cat").alias("tag"), F.lit(1).cast("long").alias("j"))),
             F.when(F.col("_rd") == 1, F.struct(F.lit("max_cat").alias("tag"), F.col("m").cast("long").alias("j")))]
    for p in percentiles:
        pl = F.lit(float(p))
        share = lambda j: (F.col("before") + F.col("c") * j) / F.col("_n")
        crossing = ((F.col("after") / F.col("_n") >= pl)
                    & ((F.col("before") == 0) | (F.col("before") / F.col("_n") < pl)))
        j0 = F.greatest(F.lit(1), F.ceil((pl * F.col("_n") - F.col("before")) / F.col("c")) - 1)
        j = (F.when(share(j0) >= pl, j0)
              .when(share(j0 + 1) >= pl, j0 + 1)
              .otherwise(F.least(j0 + 2, F.col("m"))))
        items.append(F.when(crossing, F.struct(F.lit(pct_name(p) + "_cat").alias("tag"),
                                               j.cast("long").alias("j"))))
    tg = (levels.select("variable", "c", "m", "has_null",
                        F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_t"))
                .select("variable", "c", "m", "has_null", "_t.tag", "_t.j"))
    is_null = (F.col("has_null") == 1) & (F.col("j") == F.col("m"))
    null_hits = tg.where(is_null).select("variable", "tag", F.lit(None).cast("string").alias("value"))
    named = tg.where(~is_null).select("variable", "c", "tag", (F.col("j") - 1).alias("_pos"))
    sel = select_positions(cnt.where(F.col("value").isNotNull()).select("variable", "c", "value"),
                           ["variable", "c"], "value", None, named, pos="_pos",
                           max_group_rows=ws["_n"])
    picked = sel.select("variable", "tag", "value").unionByName(null_hits)
    tags = ["min_cat", "max_cat"] + [pct_name(p) + "_cat" for p in percentiles]
    wide = picked.groupBy("variable").agg(*[
        F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags])
    return (stats.join(uniq, "variable", "left").join(wide, "variable", "left")
                 .withColumn("type", F.lit("categorical"))), groups


ASSOC_SCHEMA = ("variable string, assoc_kind string, assoc_stat double, assoc_df1 double, "
                "assoc_df2 double, assoc_value double")


def association(df: DataFrame, dv: str, regression: bool, num: list[str], cat: list[str],
                ws: dict | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Association of every variable with ``dv``.

    Columns ``variable, assoc_kind, assoc_stat, assoc_df1, assoc_df2, assoc_value``:

    * regression, numeric: Pearson r (pairwise complete), kind ``pearson_r``;
    * regression, categorical: one-way ANOVA of dv by category, p of F, ``anova_p``;
    * classification, numeric: F test of the variable on dv (regression F with
      (1, n-2) df for a numeric dv, ANOVA over dv classes otherwise), ``f_p``;
    * classification, categorical: chi-square of all dv x category cells against a
      uniform expectation (not an independence test), ``chi2_uniform_p``.

    Numeric variables against a numeric dv take one global aggregate over the
    wide table; the other cases are grouped aggregates.  The result has one
    row per variable; its p-values are computed on the driver.
    """
    spark = df.sparkSession
    dv_numeric = dv in numerical_categorical_division(df, [dv])[0]
    rows: list[tuple] = []
    if num and (regression or dv_numeric):
        st = ws if ws is not None and "an0" in ws else wide_agg(df, _pair_aggs(df, num, numeric_value(df, dv)))
        for i, c in enumerate(num):
            n, cov, sx, sy = st[f"an{i}"], st[f"ac{i}"], st[f"asx{i}"], st[f"asy{i}"]
            r = cov / (sx * sy) if None not in (cov, sx, sy) and sx * sy != 0 else None
            if regression:
                rows.append((c, "pearson_r", r, None, None, r))
            else:
                f = None if r is None or r * r == 1 else r * r * (n - 2) / (1 - r * r)
                d2 = float(n - 2)
                rows.append((c, "f_p", f, 1.0, d2, None if f is None else _nan_none(f_sf(f, 1.0, d2))))
    elif num:  # classification with a categorical dv: ANOVA of each variable over the dv classes
        long = to_long(df, num, extra={"_y": category_value(df, dv)})
        pair = long.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
        rows += _anova(pair, "variable", "_y", "value", "f_p")
    if cat:
        if regression and groups is not None:
            rows += _anova_rows(groups, "variable", "anova_p")
        elif regression:
            long = to_long(df, cat, kind="categorical", extra={"_y": numeric_value(df, dv)})
            pair = long.where(F.col("value").isNotNull() & F.col("_y").isNotNull())
            rows += _anova(pair, "variable", "value", "_y", "anova_p")
        else:
            long = to_long(df, cat, kind="categorical", extra={"_y": category_value(df, dv)})
            rows += _chi2_uniform(long)
    if not regression:  # dv against itself is degenerate in classification mode
        rows = [(v, k, None, None, None, None) if v == dv else (v, k, a, b, c, d) for v, k, a, b, c, d in rows]
    return spark.createDataFrame(rows, ASSOC_SCHEMA)


def _nan_none(v):
    return None if v is None or v != v else float(v)


def _anova(pair: DataFrame, var: str, group: str, y: str, kind: str) -> list[tuple]:
    """One-way ANOVA of ``y`` by ``group`` within each ``var``: per-group
    moments (one grouped aggregate), then per-variable sums; one row each."""
    g = pair.groupBy(var, group).agg(*_group_moment_aggs(y))
    return _anova_rows(g, var, kind)


def _group_moment_aggs(y: str) -> list[Column]:
    """Per-group count, mean and within sum of squares of y (NULL y ignored)."""
    return [F.count(y).alias("_ng"), F.avg(y).alias("_mg"),
            (F.coalesce(F.var_samp(y), F.lit(0.0)) * (F.count(y) - 1)).alias("_ssw")]


def _anova_rows(g: DataFrame, var: str, kind: str) -> list[tuple]:
    """F test from per-group moments ``_ng, _mg, _ssw``; one row per ``var``."""
    t = g.groupBy(var).agg(
        F.sum("_ng").alias("_n"), F.count(F.lit(1)).alias("_k"),
        (F.sum(F.col("_ng") * F.col("_mg")) / F.sum("_ng")).alias("_gm"),
        F.sum("_ssw").alias("_ssw"))
    # between-group sum of squares around the grand mean (second small pass, stable)
    ssb = (g.join(F.broadcast(t.select(var, "_gm")), var)
             .groupBy(var).agg(F.sum(F.col("_ng") * (F.col("_mg") - F.col("_gm")) ** 2).alias("_ssb")))
    t = t.join(ssb, var).collect()
    out = []
    for r in t:
        n, k, ssw, ssb = r["_n"], r["_k"], r["_ssw"], r["_ssb"]
        d1, d2 = float(k - 1), float(n - k)
        f = (ssb / d1) / (ssw / d2) if d1 > 0 and d2 > 0 and ssw > 0 else None
        out.append((r[var], kind, f, d1, d2, None if f is None else _nan_none(f_sf(f, d1, d2))))
    return out


def _chi2_uniform(long: DataFrame) -> list[tuple]:
    """Chi-square of the full dv x category grid (NULL is a level of its own, whatever strings there are; empty
    cells count) against equal expected counts.  Empty cells need not be built: each adds e = n / cells."""
    cells = long.groupBy("variable", "value", "_y").agg(F.count(F.lit(1)).alias("o"))
    levels = lambda c: F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
    size = cells.groupBy("variable").agg(F.sum("o").alias("_n"), (levels("value") * levels("_y")).cast("double").alias("_cells"))
    off = F.col("o") - F.col("_n") / F.col("_cells")
    t = (cells.join(F.broadcast(size), "variable").groupBy("variable", "_n", "_cells")  # one row per variable
         .agg(F.sum(off * off).alias("_off2"), F.count(F.lit(1)).alias("_full")).collect())
    out = []
    for r in t:
        ncell, e = r["_cells"], r["_n"] / r["_cells"]
        stat = r["_off2"] / e + (ncell - r["_full"]) * e
        out.append((r["variable"], "chi2_uniform_p", stat, ncell - 1, None, _nan_none(chi2_sf(stat, ncell - 1))))
    return out


def profile(df: DataFrame, dv: str | None = None, regression: bool = True,
            percentile: Sequence[float] = DEFAULT_PERCENTILES, cv: Sequence[int] = DEFAULT_CV,
            cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row per variable (numeric variables first, then categoricals, in column
    order; column ``ord`` holds that order).

    Numeric statistics sit in double columns (``min``, ``p1`` ..., ``max``);
    categorical labels in string columns (``min_cat``, ``p1_cat`` ..., ``max_cat``).
    With ``dv`` the association columns of :func:`association` are added.

    ``exact=False`` takes numeric percentiles and distinct counts from
    mergeable sketches (relative rank error about 1e-4, distinct counts within about 1 percent),
    so the numeric rows need no shuffle; categorical rows are exact either way.
    """
    num, cat = numerical_categorical_division(df, cols)
    pnames = [pct_name(p) for p in percentile]
    lo_names = [sigma_names(d)[0] for d in cv]
    hi_names = [sigma_names(d)[1] for d in cv]
    columns = (["variable", "type", "count", "nmiss", "missing_rate", "unique", "std", "skewness",
                "kurtosis", "mean", "min"] + lo_names + pnames + hi_names + ["max", "min_cat"]
               + [p + "_cat" for p in pnames] + ["max_cat"])
    scratch = Scratch()
    try:
        parts = []
        dv_numeric = dv is not None and dv in numerical_categorical_division(df, [dv])[0]
        # a numeric dv rides along in the statistics pass and the category grouping
        dv_pass = numeric_value(df, dv) if dv_numeric and num else None
        dv_groups = numeric_value(df, dv) if dv_numeric and regression and cat else None
        ws = _wide_stats(df, num, cat, None if exact else percentile, dv_y=dv_pass) if (num or cat) else {}
        if num and exact:
            parts.append(_numeric_part(df, num, percentile, cv, ws))
        elif num:
            parts.append(_numeric_part_approx(df, num, percentile, cv, ws))
        groups = None
        if cat:
            cat_part, groups = _categorical_part(df, cat, percentile, ws, scratch, dv_y=dv_groups)
            parts.append(cat_part)
        if not parts:
            raise ValueError("no columns to profile")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        out = (out.withColumn("nmiss", F.col("_n") - F.col("count"))
                  .withColumn("missing_rate", F.when(F.col("_n") > 0,
                                                     F.col("nmiss") * F.lit(100.0) / F.col("_n"))))
        for c in columns:
            if c not in out.columns:
                kind = "string" if c.endswith("_cat") else "double"
                out = out.withColumn(c, F.lit(None).cast(kind))
        out = out.withColumn("ord", variable_order(num + cat)[F.col("variable")])
        columns = columns + ["ord"]
        if dv is not None:
            assoc = association(df, dv, regression, num, cat, ws=ws, groups=groups)
            out = out.join(assoc, "variable", "left")
            columns += ["assoc_kind", "assoc_stat", "assoc_df1", "assoc_df2", "assoc_value"]
        return scratch.finish(out.select(*[qcol(c) for c in columns]))
    finally:
        scratch.release()
