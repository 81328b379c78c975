"""Registered queries: each runs one operator over the example tables.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE_SQL[name]`` is the
same result written as plain SQL over the tables (DuckDB dialect) for the
correctness check.  Every query reads whole tables.  Doubles are rounded to a
fixed number of decimals on both sides so the comparison is not sensitive to
summation order.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varkit.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DIGITS = 6


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (presentation only)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _r(expr: str, digits: int = DIGITS) -> str:
    return f"round({expr}, {digits})"


# ----------------------------------------------------------------- profile
LINEITEM_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PCTS = (.01, .05, .1, .5, .9, .95, .99)
PNAMES = ["p1", "p5", "p10", "p50", "p90", "p95", "p99"]
NUMERIC_PROFILE_COLS = (["variable", "type", "count", "nmiss", "missing_rate", "unique", "std",
                         "skewness", "kurtosis", "mean", "min", "mean-2sigma", "mean-3sigma"]
                        + PNAMES + ["mean+2sigma", "mean+3sigma", "max", "ord"])


def _long_sql(table: str, cols: list[str], cast: str = "DOUBLE") -> str:
    return "\n  UNION ALL ".join(
        f"SELECT {i} AS ord, '{c}' AS variable, CAST({c} AS {cast}) AS value FROM {table}"
        for i, c in enumerate(cols))


def _numeric_profile_sql(table: str, cols: list[str]) -> str:
    q = ",\n    ".join(f"quantile_cont(value, {p}) AS {n}" for p, n in zip(PCTS, PNAMES))
    qsel = ", ".join(f"{_r(n)} AS {n}" for n in PNAMES)
    return f"""
WITH long AS (
  {_long_sql(table, cols)}
), s AS (
  SELECT variable, min(ord) AS ord, count(value) AS cnt, count(*) AS n,
    count(DISTINCT value) AS uniq, stddev_samp(value) AS std,
    skewness(value) * (count(value) - 2) / sqrt(count(value) * (count(value) - 1.0)) AS skew,
    kurtosis_pop(value) + 3 AS kurt, avg(value) AS mean, min(value) AS mn, max(value) AS mx,
    {q}
  FROM long GROUP BY variable
)
SELECT variable, 'numeric' AS type, cnt AS count, n - cnt AS nmiss,
  {_r('(n - cnt) * 100.0 / n')} AS missing_rate, uniq AS "unique", {_r('std')} AS std,
  {_r('skew')} AS skewness, {_r('kurt')} AS kurtosis, {_r('mean')} AS mean, {_r('mn')} AS "min",
  {_r('mean - 2 * std')} AS "mean-2sigma", {_r('mean - 3 * std')} AS "mean-3sigma",
  {qsel},
  {_r('mean + 2 * std')} AS "mean+2sigma", {_r('mean + 3 * std')} AS "mean+3sigma",
  {_r('mx')} AS "max", ord
FROM s
"""


@register("profile_numeric", _numeric_profile_sql("lineitem", LINEITEM_NUM))
def q_profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "lineitem", LINEITEM_NUM)
    return rounded(profile(df).select(*[F.col(f"`{c}`") for c in NUMERIC_PROFILE_COLS]))


@register("profile_numeric_approx")
def q_profile_numeric_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch mode (percentiles and distinct counts approximate): rows-only check."""
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "lineitem", LINEITEM_NUM)
    return rounded(profile(df, exact=False).select(*[F.col(f"`{c}`") for c in NUMERIC_PROFILE_COLS]))


ORDERS_CAT = ["o_orderstatus", "o_orderpriority"]
CAT_PROFILE_COLS = (["variable", "type", "count", "nmiss", "missing_rate", "unique", "min_cat"]
                    + [p + "_cat" for p in PNAMES] + ["max_cat", "ord"])


def _categorical_profile_sql(table: str, cols: list[str]) -> str:
    picks = ",\n  ".join(
        f"(SELECT category FROM cum c WHERE c.variable = s.variable AND c.cum * 1.0 / c.n >= {p} "
        f"ORDER BY c.rn LIMIT 1) AS {n}_cat" for p, n in zip(PCTS, PNAMES))
    return f"""
WITH long AS (
  {_long_sql(table, cols, 'VARCHAR')}
), cnt AS (
  SELECT variable, min(ord) AS ord, value AS category, count(*) AS c FROM long GROUP BY variable, value
), cum AS (
  SELECT variable, category, c,
    row_number() OVER (PARTITION BY variable ORDER BY c, category NULLS LAST) AS rn,
    sum(c) OVER (PARTITION BY variable ORDER BY c, category NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(c) OVER (PARTITION BY variable) AS n
  FROM cnt
), s AS (
  SELECT variable, min(ord) AS ord, sum(c) AS n,
    sum(CASE WHEN category IS NOT NULL THEN c END) AS cnt, count(category) AS uniq
  FROM cnt GROUP BY variable
)
SELECT variable, 'categorical' AS type, CAST(cnt AS BIGINT) AS count, CAST(n - cnt AS BIGINT) AS nmiss,
  {_r('(n - cnt) * 100.0 / n')} AS missing_rate, uniq AS "unique",
  (SELECT category FROM cum c WHERE c.variable = s.variable ORDER BY c.rn LIMIT 1) AS min_cat,
  {picks},
  (SELECT category FROM cum c WHERE c.variable = s.variable ORDER BY c.rn DESC LIMIT 1) AS max_cat,
  ord
FROM s
"""


@register("profile_categorical", _categorical_profile_sql("orders", ORDERS_CAT))
def q_profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "orders", ORDERS_CAT)
    return rounded(profile(df).select(*CAT_PROFILE_COLS))


ASSOC_COLS = ["variable", "assoc_kind", "assoc_stat", "assoc_df1", "assoc_df2", "assoc_value"]


def _simpson(density: str, start: str, length: str, steps: int = 2000) -> str:
    """SQL: integral of ``density`` (in x) from ``start`` over ``length`` by Simpson's rule."""
    at = density.replace("{x}", f"({start} + ({length}) * i / {2 * steps}.0)")
    weight = f"CASE WHEN i = 0 OR i = {2 * steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({length}) / {6 * steps}.0 * list_sum(list_transform(range(0, {2 * steps + 1}), lambda i: {weight} * ({at}))))"


def _f_tail_sql(f: str, d1: str, d2: str) -> str:
    """SQL: upper tail of the F distribution for 1 (both tails of t) or 2 degrees of freedom above."""
    density = (f"exp(lgamma(({d2} + 1) / 2.0) - lgamma({d2} / 2.0) - 0.5 * ln({d2} * pi()) - (({d2} + 1) / 2.0) * ln(1 + {{x}} * {{x}} / {d2}))")
    return f"CASE {d1} WHEN 2 THEN pow({d2} / ({d2} + 2 * {f}), {d2} / 2.0) WHEN 1 THEN 2 * {_simpson(density, f'sqrt({f})', '40.0')} END"


def _chi2_tail_sql(x: str, df: str) -> str:
    """SQL: upper tail of the chi-square distribution."""
    density = f"exp(({df} / 2.0 - 1) * ln({{x}}) - {{x}} / 2 - {df} / 2.0 * ln(2.0) - lgamma({df} / 2.0))"
    return _simpson(density, x, "400.0")


@register("profile_assoc_regression", f"""
WITH nums AS (
  SELECT 'l_quantity' AS variable, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', corr(l_discount, l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem
), long AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS g, l_extendedprice AS y FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus, l_extendedprice FROM lineitem
), grp AS (
  SELECT variable, g, count(*) AS ng, avg(y) AS mg, coalesce(var_samp(y), 0) * (count(*) - 1) AS ssw
  FROM long GROUP BY variable, g
), tot AS (
  SELECT variable, sum(ng) AS n, count(*) AS k, sum(ng * mg) / sum(ng) AS gm, sum(ssw) AS ssw
  FROM grp GROUP BY variable
), anova AS (
  SELECT t.variable, t.k - 1.0 AS d1, t.n - t.k * 1.0 AS d2,
    (sum(g.ng * (g.mg - t.gm) * (g.mg - t.gm)) / (t.k - 1.0)) / (t.ssw / (t.n - t.k)) AS f
  FROM tot t JOIN grp g USING (variable) GROUP BY t.variable, t.k, t.n, t.ssw
)
SELECT variable, 'pearson_r' AS assoc_kind, {_r('r')} AS assoc_stat,
  CAST(NULL AS DOUBLE) AS assoc_df1, CAST(NULL AS DOUBLE) AS assoc_df2, {_r('r')} AS assoc_value FROM nums
UNION ALL
SELECT variable, 'anova_p', {_r('f')}, d1, d2, {_r(_f_tail_sql('f', 'CAST(d1 AS INTEGER)', 'd2'))} FROM anova
""")
def q_profile_assoc_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "lineitem", LINEITEM_NUM + ["l_returnflag", "l_linestatus"])
    return rounded(profile(df, dv="l_extendedprice").select(*ASSOC_COLS))


@register("profile_assoc_class", f"""
WITH base AS (
  SELECT *, CAST(l_returnflag = 'R' AS INTEGER) AS y01 FROM lineitem
), nums AS (
  SELECT 'l_quantity' AS variable, corr(l_quantity, y01) AS r, count(*) AS n FROM base
  UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, y01), count(*) FROM base
  UNION ALL SELECT 'l_discount', corr(l_discount, y01), count(*) FROM base
  UNION ALL SELECT 'l_tax', corr(l_tax, y01), count(*) FROM base
), long AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS v, CAST(y01 AS VARCHAR) AS y FROM base
  UNION ALL SELECT 'l_linestatus', l_linestatus, CAST(y01 AS VARCHAR) FROM base
), cells AS (
  SELECT variable, v, y, count(*) AS o FROM long GROUP BY ALL
), chi AS (
  SELECT variable, sum(o) AS n, sum(o * o) AS o2, count(DISTINCT coalesce(v, '~')) AS a,
    count(DISTINCT coalesce(y, '~')) AS b FROM cells GROUP BY variable
)
SELECT variable, 'f_p' AS assoc_kind, {_r('r * r * (n - 2) / (1 - r * r)')} AS assoc_stat,
  1.0 AS assoc_df1, CAST(n - 2 AS DOUBLE) AS assoc_df2, {_r(_f_tail_sql('(r * r * (n - 2) / (1 - r * r))', '1', '(n - 2.0)'))} AS assoc_value FROM nums
UNION ALL
SELECT 'y01', 'f_p', NULL, NULL, NULL, NULL
UNION ALL
SELECT variable, 'chi2_uniform_p', {_r('o2 / (n / (a * b * 1.0)) - n')}, a * b - 1.0, NULL,
  {_r(_chi2_tail_sql('(o2 / (n / (a * b * 1.0)) - n)', '(a * b - 1.0)'))} FROM chi
""")
def q_profile_assoc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.profile import profile
    df = (read_table(spark, sf_dir, "lineitem", LINEITEM_NUM + ["l_returnflag", "l_linestatus"])
          .withColumn("y01", (F.col("l_returnflag") == "R").cast("int")))
    return rounded(profile(df, dv="y01", regression=False).select(*ASSOC_COLS))


@register("profile_assoc_string", f"""
WITH base AS (SELECT CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_mktsegment AS g, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer
  WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY')),
long AS (
  SELECT 'c_acctbal' AS variable, g, c_acctbal AS y FROM base UNION ALL SELECT 'c_nationkey', g, c_nationkey FROM base
), grp AS (
  SELECT variable, g, count(*) AS ng, avg(y) AS mg, coalesce(var_samp(y), 0) * (count(*) - 1) AS ssw
  FROM long WHERE y IS NOT NULL AND g IS NOT NULL GROUP BY variable, g
), tot AS (
  SELECT variable, sum(ng) AS n, count(*) AS k, sum(ng * mg) / sum(ng) AS gm, sum(ssw) AS ssw FROM grp GROUP BY variable
), anova AS (
  SELECT t.variable, t.k - 1.0 AS d1, t.n - t.k * 1.0 AS d2,
    (sum(g.ng * (g.mg - t.gm) * (g.mg - t.gm)) / (t.k - 1.0)) / (t.ssw / (t.n - t.k)) AS f
  FROM tot t JOIN grp g USING (variable) GROUP BY t.variable, t.k, t.n, t.ssw
)
SELECT variable, 'f_p' AS assoc_kind, {_r('f')} AS assoc_stat, d1 AS assoc_df1, d2 AS assoc_df2,
  {_r(_f_tail_sql('f', 'CAST(d1 AS INTEGER)', 'd2'))} AS assoc_value FROM anova
UNION ALL SELECT 'c_mktsegment', 'chi2_uniform_p', NULL, NULL, NULL, NULL
""")
def q_profile_assoc_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification with classes named by strings: ANOVA of the numeric columns over three market segments."""
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "customer", ["c_acctbal", "c_nationkey", "c_mktsegment"])
    df = df.where(F.col("c_mktsegment").isin("BUILDING", "FURNITURE", "MACHINERY"))
    return rounded(profile(df, dv="c_mktsegment", regression=False).select(*ASSOC_COLS))


MIXED_COLS = NUMERIC_PROFILE_COLS[:-1] + ["min_cat"] + [p + "_cat" for p in PNAMES] + ["max_cat", "ord"]


def _mixed_profile_sql(table: str, num: list[str], cat: list[str]) -> str:
    """Numeric variables first, then categorical ones, in column order; what a kind does not have is NULL."""
    def part(sql: str, own: list[str], first: int) -> str:
        cols = [f'ord + {first} AS ord' if c == "ord" else f'"{c}"' if c in own else f'CAST(NULL AS {"VARCHAR" if c.endswith("_cat") else "DOUBLE"}) AS "{c}"'
                for c in MIXED_COLS]
        return f"SELECT {', '.join(cols)} FROM ({sql})"
    return (part(_numeric_profile_sql(table, num), NUMERIC_PROFILE_COLS, 0) + "\nUNION ALL\n"
            + part(_categorical_profile_sql(table, cat), CAT_PROFILE_COLS, len(num)))


@register("profile_mixed", _mixed_profile_sql("orders", ["o_totalprice", "o_custkey"], ORDERS_CAT))
def q_profile_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile of numeric and categorical columns together."""
    from varkit.operators.profile import profile
    df = read_table(spark, sf_dir, "orders", ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey"])
    return rounded(profile(df.select("o_totalprice", "o_orderstatus", "o_custkey", "o_orderpriority")).select(*[F.col(f"`{c}`") for c in MIXED_COLS]))


# ------------------------------------------------------------------ trends
def _trend_sql_tail(src: str) -> str:
    """Shared SQL for the numeric trend table given ``bucketed(variable, v, y, side, sb)``."""
    return f"""
agg AS (
  SELECT variable, side, sb, min(v) AS minima, sum(v) AS var_sum, max(v) AS maxima,
    count(*) AS counts, CAST(sum(y) AS BIGINT) AS dep_sum
  FROM {src} GROUP BY variable, side, sb
)
SELECT variable,
  row_number() OVER (PARTITION BY variable ORDER BY minima NULLS LAST, side, sb) AS bucket,
  {_r('minima')} AS minima, {_r('var_sum')} AS var_sum, {_r('maxima')} AS maxima, counts, dep_sum,
  {_r('var_sum / counts')} AS var_avg, {_r('dep_sum / counts')} AS dep_avg
FROM agg
"""


_TREND_SQL_HEAD = """
st AS (
  SELECT variable,
    sum(CASE WHEN v < 0 THEN 1 ELSE 0 END) AS n_neg, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS n_pos,
    min(v) AS vmin, max(v) AS vmax
  FROM base WHERE v IS NOT NULL GROUP BY variable
), st2 AS (
  SELECT *,
    CAST(greatest(1, coalesce(ceil({B} * n_neg / nullif(n_neg + n_pos, 0)), 1)) AS BIGINT) AS b_neg,
    CAST(greatest(1, coalesce(ceil({B} * n_pos / nullif(n_neg + n_pos, 0)), 1)) AS BIGINT) AS b_pos
  FROM st
), st3 AS (
  SELECT *, ceil(n_neg / b_neg) AS r_neg, ceil(n_pos / b_pos) AS r_pos,
    n_neg > 0 AND -vmin > 1 AS neg_eqf, n_pos > 0 AND vmax > 1 AS pos_eqf,
    pow(10.0, ceil(log10(-vmin))) AS m_neg, pow(10.0, ceil(log10(vmax))) AS m_pos
  FROM st2
), side AS (
  SELECT b.*, CASE WHEN v < 0 THEN 0 WHEN v = 0 THEN 1 WHEN v > 0 THEN 2 ELSE 3 END AS side FROM base b
), ranked AS (
  SELECT s.*, rank() OVER (PARTITION BY variable, side ORDER BY v) AS rk FROM side s
), edges AS (
  SELECT variable, 0 AS side, (-m_neg / b_neg) * i AS e FROM st3, range(1, b_neg + 1) t(i)
  WHERE n_neg > 0 AND NOT neg_eqf
  UNION ALL
  SELECT variable, 2, (m_pos / b_pos) * i FROM st3, range(1, b_pos) t(i) WHERE n_pos > 0 AND NOT pos_eqf
), bucketed AS (
  SELECT r.variable, r.v, r.y, r.side,
    CASE
      WHEN r.side = 0 AND s.neg_eqf THEN floor(r.rk / s.r_neg) + 1
      WHEN r.side = 0 THEN 1 + (SELECT count(*) FROM edges e WHERE e.variable = r.variable AND e.side = 0 AND e.e < r.v)
      WHEN r.side = 2 AND s.pos_eqf THEN floor(r.rk / s.r_pos) + 1
      WHEN r.side = 2 THEN 1 + (SELECT count(*) FROM edges e WHERE e.variable = r.variable AND e.side = 2 AND e.e < r.v)
                           + CASE WHEN r.v = 1 THEN 1 ELSE 0 END
      ELSE 0 END AS sb
  FROM ranked r JOIN st3 s USING (variable)
),"""


def _trend_sql(long_sql: str, buckets: int) -> str:
    return ("WITH base AS (\n  " + long_sql + "\n)," + _TREND_SQL_HEAD.replace("{B}", f"{float(buckets)}")
            + _trend_sql_tail("bucketed"))


@register("trends_numeric", _trend_sql(
    "SELECT 'c_acctbal' AS variable, c_acctbal AS v, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer", 10))
def q_trends_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import numeric_trends
    df = (read_table(spark, sf_dir, "customer", ["c_acctbal", "c_mktsegment"])
          .withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("int")))
    return rounded(numeric_trends(df, ["c_acctbal"], "y", 10))


@register("trends_numeric_unit", _trend_sql(
    "SELECT 'l_discount' AS variable, l_discount AS v, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y "
    "FROM lineitem UNION ALL SELECT 'l_tax', l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END "
    "FROM lineitem", 10))
def q_trends_numeric_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import numeric_trends
    df = (read_table(spark, sf_dir, "lineitem", ["l_discount", "l_tax", "l_returnflag"])
          .withColumn("y", (F.col("l_returnflag") == "R").cast("int")))
    return rounded(numeric_trends(df, ["l_discount", "l_tax"], "y", 10))


@register("trends_categorical", f"""
WITH long AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS category,
    CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END FROM lineitem
)
SELECT variable, category, count(*) AS counts, CAST(sum(y) AS BIGINT) AS dep_sum,
  {_r('sum(y) / count(*)')} AS dep_avg
FROM long GROUP BY variable, category
""")
def q_trends_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import categorical_trends
    df = (read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"])
          .withColumn("y", (F.col("l_quantity") > 25).cast("int")))
    return rounded(categorical_trends(df, ["l_returnflag", "l_linestatus"], "y"))


TREND_ROLES = {"l_tax": "N", "l_returnflag": "C", "l_linestatus": "C", "l_quantity": "-", "y": "L"}


@register("trend_tables", f"""
WITH num AS ({_trend_sql("SELECT 'l_tax' AS variable, l_tax AS v, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem", 5)}),
long AS (
  SELECT 'l_returnflag' AS variable, l_returnflag AS category, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem
  UNION ALL SELECT 'l_linestatus', l_linestatus, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END FROM lineitem
)
SELECT variable, bucket, CAST(NULL AS VARCHAR) AS category, minima, maxima, counts, dep_sum, dep_avg FROM num
UNION ALL
SELECT variable, NULL, category, NULL, NULL, count(*), CAST(sum(y) AS BIGINT), {_r('sum(y) / count(*)')} FROM long GROUP BY variable, category
""")
def q_trend_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trend tables from one declaration of roles; columns of other roles are left out."""
    from varkit.operators.trends import trend_tables
    df = read_table(spark, sf_dir, "lineitem", ["l_tax", "l_quantity", "l_returnflag", "l_linestatus"])
    num, cat = trend_tables(df.withColumn("y", (F.col("l_quantity") > 25).cast("int")), TREND_ROLES, 5)
    columns = ["variable", "bucket", "category", "minima", "maxima", "counts", "dep_sum", "dep_avg"]
    return rounded(num.unionByName(cat, allowMissingColumns=True).select(*columns))


@register("binned_line", f"""
WITH long AS (
  SELECT 'l_quantity' AS variable, l_quantity AS v, l_extendedprice AS y FROM lineitem
  UNION ALL SELECT 'l_discount', l_discount, l_extendedprice FROM lineitem
  UNION ALL SELECT 'l_tax', l_tax, l_extendedprice FROM lineitem
), ranked AS (
  SELECT *, rank() OVER (PARTITION BY variable ORDER BY v) AS rk,
    ceil(count(*) OVER (PARTITION BY variable) / 10.0) AS r FROM long WHERE v IS NOT NULL
), agg AS (
  SELECT variable, floor(rk / r) + 1 AS b, min(v) AS x_min, max(v) AS x_max, avg(v) AS x_avg,
    avg(y) AS dv_avg, count(*) AS n FROM ranked GROUP BY variable, floor(rk / r) + 1
)
SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY b) AS bucket,
  {_r('x_min')} AS x_min, {_r('x_max')} AS x_max, {_r('x_avg')} AS x_avg, {_r('dv_avg')} AS dv_avg, n
FROM agg
""")
def q_binned_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import binned_line
    df = read_table(spark, sf_dir, "lineitem", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return rounded(binned_line(df, "l_extendedprice", 10))


_BOX_TAIL = f"""), q AS (
  SELECT variable, "group", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
    quantile_cont(x, 0.75) AS q3 FROM long WHERE x IS NOT NULL AND "group" IS NOT NULL
  GROUP BY variable, "group"
), j AS (
  SELECT l.*, q.q1, q.median, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
  FROM long l JOIN q USING (variable, "group")
)
SELECT variable, "group", count(*) AS n, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3,
  {_r('min(CASE WHEN x >= lo AND x <= hi THEN x END)')} AS whisker_lo,
  {_r('max(CASE WHEN x >= lo AND x <= hi THEN x END)')} AS whisker_hi,
  CAST(sum(CASE WHEN x >= lo AND x <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM j GROUP BY variable, "group", q1, median, q3
"""


@register("box_stats", """
WITH long AS (
  SELECT 'p_brand' AS variable, p_brand AS "group", p_retailprice AS x FROM part
  UNION ALL SELECT 'p_type', p_type, p_retailprice FROM part
""" + _BOX_TAIL)
def q_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import box_stats
    df = read_table(spark, sf_dir, "part", ["p_brand", "p_type", "p_retailprice"])
    return rounded(box_stats(df, "p_retailprice", regression=True))


@register("box_stats_class", """
WITH long AS (
  SELECT 'l_quantity' AS variable, l_returnflag AS "group", l_quantity AS x FROM lineitem
  UNION ALL SELECT 'l_extendedprice', l_returnflag, l_extendedprice FROM lineitem
""" + _BOX_TAIL)
def q_box_stats_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classification branch: numeric columns by the classes of the dependent variable."""
    from varkit.operators.trends import box_stats
    df = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    return rounded(box_stats(df, "l_returnflag", regression=False))


@register("column_percent", f"""
WITH cells AS (
  SELECT o_orderpriority AS category, o_orderstatus AS dv, count(*) AS c FROM orders GROUP BY ALL
), cats AS (SELECT DISTINCT category FROM cells), dvs AS (SELECT DISTINCT dv FROM cells),
grid AS (
  SELECT 'o_orderpriority' AS variable, cats.category, dvs.dv, coalesce(c.c, 0) AS count
  FROM cats, dvs LEFT JOIN cells c ON c.category IS NOT DISTINCT FROM cats.category
    AND c.dv IS NOT DISTINCT FROM dvs.dv
)
SELECT variable, category, dv, count,
  {_r('count * 100.0 / sum(count) OVER (PARTITION BY variable, category)')} AS pct
FROM grid
""")
def q_column_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.trends import column_percent
    df = read_table(spark, sf_dir, "orders", ["o_orderpriority", "o_orderstatus"])
    return rounded(column_percent(df, "o_orderstatus"))


# --------------------------------------------------------------- treatment
@register("cap_floor", f"""
SELECT c_custkey,
  {_r('CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal > 9000 THEN 9000 ELSE c_acctbal END')} AS c_acctbal
FROM customer
""")
def q_cap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.treat import cap_floor
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"])
    return rounded(cap_floor(df, "c_acctbal", 9000.0, 0.0))


@register("dummies", """
SELECT c_custkey, c_mktsegment,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_dum_MACHINERY,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_dum_FURNITURE,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_dum_BUILDING,
  CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1 ELSE 0 END AS c_mktsegment_dum_AUTOMOBILE
FROM customer
""")
def q_dummies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.treat import dummies
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return dummies(df, "c_mktsegment")[0]


@register("dummies_binary", """
WITH freq AS (
  SELECT o_orderpriority AS cat,
    row_number() OVER (ORDER BY count(*) DESC, o_orderpriority NULLS LAST) - 1 AS code
  FROM orders GROUP BY o_orderpriority
)
SELECT o_orderkey, o_orderpriority,
  CAST(coalesce((f.code >> 0) & 1, 0) AS INTEGER) AS o_orderpriority_dum_0,
  CAST(coalesce((f.code >> 1) & 1, 0) AS INTEGER) AS o_orderpriority_dum_1,
  CAST(coalesce((f.code >> 2) & 1, 0) AS INTEGER) AS o_orderpriority_dum_2
FROM orders o LEFT JOIN freq f ON o.o_orderpriority = f.cat
""")
def q_dummies_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.treat import dummies_binary
    df = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    return dummies_binary(df, "o_orderpriority")[0]


@register("dummies_sparse", """
WITH freq AS (
  SELECT p_type AS cat, row_number() OVER (ORDER BY count(*) DESC, p_type NULLS LAST) - 1 AS code, count(*) OVER () AS k
  FROM part GROUP BY p_type
)
SELECT p.p_partkey, p.p_type, CAST(f.k - 1 AS INTEGER) AS width, CASE WHEN f.code < f.k - 1 AND p.p_type IS NOT NULL THEN f.code END AS hot
FROM part p JOIN freq f ON f.cat IS NOT DISTINCT FROM p.p_type
""")
def q_dummies_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse one-hot vector of the part type, shown by its width and the place of its one."""
    from pyspark.ml.functions import vector_to_array
    from varkit.operators.treat import dummies_sparse
    out, _ = dummies_sparse(read_table(spark, sf_dir, "part", ["p_partkey", "p_type"]), "p_type")
    hot = F.array_position(vector_to_array("p_type_dum"), F.lit(1.0))
    return out.select("p_partkey", "p_type", F.size(vector_to_array("p_type_dum")).alias("width"), F.when(hot > 0, hot - 1).alias("hot"))


@register("smooth_tails", f"""
WITH RECURSIVE p AS (
  SELECT quantile_cont(o_totalprice, 0.01) AS p1, quantile_cont(o_totalprice, 0.05) AS p5,
    quantile_cont(o_totalprice, 0.95) AS p95, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders
), hb AS (
  SELECT o_totalprice AS a, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i
  FROM orders, p WHERE o_totalprice BETWEEN p95 AND p99
), hs(i, s) AS (
  SELECT i, a FROM hb WHERE i = 0
  UNION ALL
  SELECT hb.i, 0.5 * hb.a + 0.5 * hs.s FROM hs JOIN hb ON hb.i = hs.i + 1
), ht AS (
  SELECT o_orderkey, o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k
  FROM orders, p WHERE o_totalprice > p99
), hc(k, o_orderkey, s) AS (
  SELECT 0, CAST(NULL AS BIGINT), (SELECT s FROM hs ORDER BY i DESC LIMIT 1)
  UNION ALL
  SELECT ht.k, ht.o_orderkey, 0.5 * ht.x + 0.5 * hc.s FROM hc JOIN ht ON ht.k = hc.k + 1
), lb AS (
  SELECT o_totalprice AS a, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i,
    count(*) OVER () AS m
  FROM orders, p WHERE o_totalprice BETWEEN p1 AND p5
), ls(i, s) AS (
  SELECT m - 2, a FROM lb WHERE i = m - 1
  UNION ALL
  SELECT ls.i - 1, 0.5 * lb.a + 0.5 * ls.s FROM ls JOIN lb ON lb.i = ls.i + 1 WHERE ls.i > 0
), lt AS (
  SELECT o_orderkey, o_totalprice AS x,
    row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS k
  FROM orders, p WHERE o_totalprice < p1
), lc(k, o_orderkey, s) AS (
  SELECT 0, CAST(NULL AS BIGINT), (SELECT s FROM ls ORDER BY i LIMIT 1)
  UNION ALL
  SELECT lt.k, lt.o_orderkey, 0.5 * lt.x + 0.5 * lc.s FROM lc JOIN lt ON lt.k = lc.k + 1
), smoothed AS (
  SELECT o_orderkey, s FROM hc WHERE k > 0 UNION ALL SELECT o_orderkey, s FROM lc WHERE k > 0
)
SELECT o.o_orderkey, {_r('coalesce(sm.s, o.o_totalprice)')} AS o_totalprice
FROM orders o LEFT JOIN smoothed sm USING (o_orderkey)
""")
def q_smooth_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.treat import smooth_tails
    df = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"])
    return rounded(smooth_tails(df, "o_totalprice", "o_orderkey", .5))


# ----------------------------------------------------------- moments / reduction
EMB_K = 64


def _emb_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings", ["embedding"])
    return emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_K)])


def _corr_pairs_sql() -> str:
    parts = []
    for i in range(EMB_K):
        for j in range(i + 1, EMB_K):
            parts.append(f"SELECT 'e{i}' AS var_a, 'e{j}' AS var_b, "
                         f"{_r(f'corr(CAST(embedding[{i + 1}] AS DOUBLE), CAST(embedding[{j + 1}] AS DOUBLE))')}"
                         f" AS r FROM embeddings")
    return "\nUNION ALL ".join(parts)


@register("corr_long", _corr_pairs_sql())
def q_corr_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.moments import correlation_matrix, long_pairs
    cols, m = correlation_matrix(_emb_frame(spark, sf_dir))
    return rounded(long_pairs(spark, cols, m))


# Derived lineitem variables with a known correlation structure.
RED_COLS = ["price", "revenue", "tax", "tax_qty", "qty", "discount"]


def _red_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_extendedprice", "l_discount", "l_tax", "l_quantity"])
    return li.select(F.col("l_extendedprice").alias("price"),
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                     F.col("l_tax").alias("tax"), (F.col("l_tax") * F.col("l_quantity")).alias("tax_qty"),
                     F.col("l_quantity").alias("qty"), F.col("l_discount").alias("discount"))


_RED_SQL = """
base AS (
  SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS revenue, l_tax AS tax,
    l_tax * l_quantity AS tax_qty, l_quantity AS qty, l_discount AS discount FROM lineitem
), nodes(idx, name) AS (
  VALUES (0, 'price'), (1, 'revenue'), (2, 'tax'), (3, 'tax_qty'), (4, 'qty'), (5, 'discount')
), pairs AS (
  SELECT 0 AS a, 1 AS b, corr(price, revenue) AS r FROM base
  UNION ALL SELECT 0, 2, corr(price, tax) FROM base UNION ALL SELECT 0, 3, corr(price, tax_qty) FROM base
  UNION ALL SELECT 0, 4, corr(price, qty) FROM base UNION ALL SELECT 0, 5, corr(price, discount) FROM base
  UNION ALL SELECT 1, 2, corr(revenue, tax) FROM base UNION ALL SELECT 1, 3, corr(revenue, tax_qty) FROM base
  UNION ALL SELECT 1, 4, corr(revenue, qty) FROM base UNION ALL SELECT 1, 5, corr(revenue, discount) FROM base
  UNION ALL SELECT 2, 3, corr(tax, tax_qty) FROM base UNION ALL SELECT 2, 4, corr(tax, qty) FROM base
  UNION ALL SELECT 2, 5, corr(tax, discount) FROM base UNION ALL SELECT 3, 4, corr(tax_qty, qty) FROM base
  UNION ALL SELECT 3, 5, corr(tax_qty, discount) FROM base UNION ALL SELECT 4, 5, corr(qty, discount) FROM base
), sym AS (
  SELECT a, b, r FROM pairs UNION ALL SELECT b, a, r FROM pairs
), edges AS (SELECT a, b FROM sym WHERE abs(r) > {cut}),
reach(src, dst) AS (
  SELECT idx, idx FROM nodes
  UNION
  SELECT reach.src, edges.b FROM reach JOIN edges ON edges.a = reach.dst
), comp AS (
  SELECT src AS idx, min(dst) AS root FROM reach GROUP BY src
), clusters AS (
  SELECT c.idx, n.name, dense_rank() OVER (ORDER BY c.root) - 1 AS cluster FROM comp c JOIN nodes n USING (idx)
)"""


@register("corr_clusters", "WITH RECURSIVE " + _RED_SQL.replace("{cut}", "0.65") + """
SELECT CAST(cluster AS BIGINT) AS cluster, name AS variable FROM clusters
""")
def q_corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import clusters_frame, correlation_clusters
    cl = correlation_clusters(_red_frame(spark, sf_dir), cutoff=.65)
    return clusters_frame(spark, cl).select("cluster", "variable")


@register("varclus", "WITH RECURSIVE " + _RED_SQL.replace("{cut}", "0.65") + f""",
size AS (SELECT cluster, count(*) AS sz FROM clusters GROUP BY cluster),
cdist AS (
  SELECT x.cluster AS c1, y.cluster AS c2, max(abs(s.r)) AS d
  FROM sym s JOIN clusters x ON x.idx = s.a JOIN clusters y ON y.idx = s.b
  WHERE x.cluster <> y.cluster GROUP BY x.cluster, y.cluster
), nxt AS (
  SELECT c1 AS cluster, arg_max(c2, d * 1000 - c2 * 1e-9) AS ncl FROM cdist WHERE d > 0 GROUP BY c1
), own AS (
  SELECT x.idx, x.name, x.cluster, s.r * s.r AS r2_own
  FROM clusters x JOIN size USING (cluster)
  JOIN clusters o ON o.cluster = x.cluster AND o.idx <> x.idx
  JOIN sym s ON s.a = x.idx AND s.b = o.idx
  WHERE size.sz = 2
), nr AS (
  SELECT w.idx, w.name, w.cluster, w.r2_own,
    CASE WHEN (SELECT sz FROM size WHERE cluster = nx.ncl) = 1 THEN
      (SELECT s.r * s.r FROM sym s JOIN clusters m ON m.idx = s.b WHERE s.a = w.idx AND m.cluster = nx.ncl)
    END AS r2_next
  FROM own w LEFT JOIN nxt nx USING (cluster)
), ratio AS (
  SELECT *, (1 - r2_own) / (1 - coalesce(r2_next, 0)) AS ratio FROM nr
)
SELECT name AS variable, CAST(cluster AS BIGINT) AS cluster, {_r('r2_own')} AS r2_own,
  {_r('r2_next')} AS r2_next, {_r('ratio')} AS ratio,
  ratio = min(ratio) OVER (PARTITION BY cluster) AS kept
FROM ratio
UNION ALL
SELECT c.name, CAST(c.cluster AS BIGINT), NULL, NULL, NULL, TRUE
FROM clusters c JOIN size USING (cluster) WHERE size.sz = 1
""")
def q_varclus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import varclus_table
    rows = varclus_table(_red_frame(spark, sf_dir), cutoff=.65)
    df = spark.createDataFrame(
        [(r["variable"], int(r["cluster"]), r["r2_own"], r["r2_next"], r["ratio"], bool(r["kept"])) for r in rows],
        "variable string, cluster long, r2_own double, r2_next double, ratio double, kept boolean")
    return rounded(df)


VIF_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


@register("vif", f"""
WITH g AS (
  SELECT sum(l_quantity * l_quantity) AS a11, sum(l_quantity * l_extendedprice) AS a12,
    sum(l_quantity * l_tax) AS a13, sum(l_extendedprice * l_extendedprice) AS a22,
    sum(l_extendedprice * l_tax) AS a23, sum(l_tax * l_tax) AS a33 FROM lineitem
), d AS (
  SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det
  FROM g
)
SELECT 'l_quantity' AS variable, {_r('a11 * (a22 * a33 - a23 * a23) / det')} AS vif FROM d
UNION ALL SELECT 'l_extendedprice', {_r('a22 * (a11 * a33 - a13 * a13) / det')} FROM d
UNION ALL SELECT 'l_tax', {_r('a33 * (a11 * a22 - a12 * a12) / det')} FROM d
""")
def q_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import vif_table
    rows = vif_table(read_table(spark, sf_dir, "lineitem", VIF_COLS))
    return rounded(spark.createDataFrame(rows, "variable string, vif double"))


@register("vif_corr", f"""
WITH r AS (
  SELECT corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, l_tax) AS r13,
    corr(l_extendedprice, l_tax) AS r23 FROM lineitem
), d AS (SELECT *, 1 - r12 * r12 - r13 * r13 - r23 * r23 + 2 * r12 * r13 * r23 AS det FROM r)
SELECT 'l_quantity' AS variable, {_r('(1 - r23 * r23) / det')} AS vif FROM d
UNION ALL SELECT 'l_extendedprice', {_r('(1 - r13 * r13) / det')} FROM d
UNION ALL SELECT 'l_tax', {_r('(1 - r12 * r12) / det')} FROM d
""")
def q_vif_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import centred_vif
    rows = centred_vif(read_table(spark, sf_dir, "lineitem", VIF_COLS))
    return rounded(spark.createDataFrame(rows, "variable string, vif double"))


@register("backward_ols", f"""
WITH g AS (
  SELECT count(*) AS n, sum(l_quantity * l_quantity) AS a11, sum(l_quantity * l_tax) AS a12,
    sum(l_tax * l_tax) AS a22, sum(l_quantity * l_extendedprice) AS b1, sum(l_tax * l_extendedprice) AS b2,
    sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem
), inv AS (
  SELECT *, a11 * a22 - a12 * a12 AS det FROM g
), beta AS (
  SELECT *, (a22 * b1 - a12 * b2) / det AS c1, (a11 * b2 - a12 * b1) / det AS c2 FROM inv
), s AS (
  SELECT *, (yy - c1 * b1 - c2 * b2) / (n - 2) AS s2 FROM beta
)
SELECT 'l_quantity' AS variable, {_r('c1')} AS coef, {_r('c1 / sqrt(s2 * a22 / det)')} AS t FROM s
UNION ALL SELECT 'l_tax', {_r('c2')}, {_r('c2 / sqrt(s2 * a11 / det)')} FROM s
""")
def q_backward_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import ols_no_intercept
    df = read_table(spark, sf_dir, "lineitem", ["l_quantity", "l_tax", "l_extendedprice"])
    rows = ols_no_intercept(df, "l_extendedprice", ["l_quantity", "l_tax"])
    return rounded(spark.createDataFrame([(r["variable"], r["coef"], r["t"]) for r in rows],
                                         "variable string, coef double, t double"))


def _doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    feats = docs.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
                        F.size(F.split("text", "\n")).cast("double").alias("n_lines"),
                        F.length(F.regexp_replace("text", r"[^0-9]", "")).cast("double").alias("n_digits"))
    return feats.join(labels, "doc_id", "left")


DOC_FEATURES = ["n_chars", "n_words", "n_lines", "n_digits"]


@register("backward_logit")
def q_backward_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.reduce import backward_selection
    df = _doc_features(spark, sf_dir).where("quality IS NOT NULL")
    dropped = backward_selection(df, "quality", regression=False, cols=DOC_FEATURES + ["quality"])
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(dropped)], "step int, variable string")


# ---- logistic fit: Newton steps unrolled in SQL
LOGIT_STEPS = 14


def _logit_sql() -> str:
    steps = ["s0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
    sums = ("any_value(b1) AS b1, any_value(b2) AS b2, sum(p * (1 - p) * a * a) AS h11, sum(p * (1 - p) * a * b) AS h12, "
            "sum(p * (1 - p) * b * b) AS h22, sum((y - p) * a) AS g1, sum((y - p) * b) AS g2")
    at = "(SELECT a, b, y, b1, b2, 1 / (1 + exp(-(b1 * a + b2 * b))) AS p FROM d, {s})"
    for i in range(LOGIT_STEPS):
        det = "(h11 * h22 - h12 * h12)"
        steps.append(f"s{i + 1} AS (SELECT b1 + (h22 * g1 - h12 * g2) / {det} AS b1, b2 + (h11 * g2 - h12 * g1) / {det} AS b2 "
                     f"FROM (SELECT {sums} FROM {at.replace('{s}', f's{i}')}))")
    last = f"(SELECT {sums} FROM {at.replace('{s}', f's{LOGIT_STEPS}')})"
    density = "exp(-{x} * {x} / 2) / sqrt(2 * pi())"
    return f"""
WITH d AS (
  SELECT d.n_chars / 1000.0 AS a, (length(d.text) - length(replace(d.text, chr(10), '')) + 1) / 10.0 AS b, CAST(l.quality AS DOUBLE) AS y
  FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL AND d.n_chars IS NOT NULL AND l.quality IS NOT NULL
), {', '.join(steps)},
e AS (SELECT *, h11 * h22 - h12 * h12 AS det FROM {last}),
f AS (
  SELECT 'kchars' AS variable, b1 AS coef, sqrt(h22 / det) AS se FROM e UNION ALL SELECT 'lines10', b2, sqrt(h11 / det) FROM e
)
SELECT variable, {_r('coef')} AS coef, {_r('se')} AS se, {_r('coef / se', 4)} AS z, {_r('2 * ' + _simpson(density, 'abs(coef / se)', '40.0'))} AS p FROM f
UNION ALL SELECT 'kchars2', NULL, NULL, NULL, NULL
"""


def _label_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "n_chars"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality"])
    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    return docs.join(labels, "doc_id").select((F.col("n_chars") / 1000.0).alias("kchars"), (F.col("n_chars") / 500.0).alias("kchars2"),
                                              (lines / 10.0).alias("lines10"), F.col("quality").cast("double").alias("quality")).dropna()


@register("logit_fit", _logit_sql())
def q_logit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fit of the quality label, without intercept; a column that is a multiple of another has no coefficient."""
    from varkit.operators.logit import logit_fit
    names = ["kchars", "kchars2", "lines10"]
    fit = logit_fit(_label_frame(spark, sf_dir), names, "quality")
    none = lambda v: None if v != v else float(v)
    rows = [(n, *[none(x[i]) for x in (fit.coef, fit.se, fit.z, fit.p)]) for i, n in enumerate(names)]
    out = spark.createDataFrame(rows, "variable string, coef double, se double, z double, p double")
    return rounded(out.select("variable", "coef", "se", F.round("z", 4).alias("z"), "p"))


# ---- elimination rounds of ordinary least squares on embedding dimensions
OLS_X, OLS_Y, OLS_ALPHA = ("e1", "e2", "e3"), "e0", 0.05


def _ols_rounds_sql() -> str:
    from itertools import combinations
    names = [*OLS_X, OLS_Y]
    at = {c: f"CAST(embedding[{int(c[1:]) + 1}] AS DOUBLE)" for c in names}
    gram = ", ".join(f"sum({at[a]} * {at[b]}) AS {a}{b}" for i, a in enumerate(names) for b in names[i:])
    g = lambda a, b: f"{a}{b}" if names.index(a) <= names.index(b) else f"{b}{a}"

    def det(rows, cols):
        if not rows:
            return "1.0"
        return "(" + " + ".join(f"({'-' if j % 2 else ''}1.0) * {g(rows[0], c)} * {det(rows[1:], [x for x in cols if x != c])}" for j, c in enumerate(cols)) + ")"

    def minor(s, a, b):
        i, j = s.index(a), s.index(b)
        return f"({'-' if (i + j) % 2 else ''}1.0) * {det([x for x in s if x != a], [x for x in s if x != b])}"
    parts = []
    for k in range(1, len(OLS_X) + 1):
        for s in map(list, combinations(OLS_X, k)):
            name = "".join(s)
            beta = {a: "((" + " + ".join(f"{minor(s, a, b)} * {g(b, OLS_Y)}" for b in s) + f") / {det(s, s)})" for a in s}
            rss = f"({g(OLS_Y, OLS_Y)} - ({' + '.join(f'{beta[a]} * {g(a, OLS_Y)}' for a in s)}))"
            for a in s:
                t = f"({beta[a]} / sqrt({rss} / (n - {k}) * ({minor(s, a, a)}) / {det(s, s)}))"
                parts.append(f"SELECT '{name}' AS fit, '{a}' AS variable, {t} AS t, n - {k}.0 AS dof FROM gram")
    left = lambda r: "replace(fit, variable, '')"
    rounds = [f"r1 AS (SELECT 1 AS step, * FROM p WHERE fit = '{''.join(OLS_X)}' AND p > {OLS_ALPHA} ORDER BY p DESC LIMIT 1)"]
    for i in range(2, len(OLS_X)):
        rounds.append(f"r{i} AS (SELECT {i} AS step, p.* FROM p WHERE fit = (SELECT {left(i)} FROM r{i - 1}) AND p > {OLS_ALPHA} ORDER BY p DESC LIMIT 1)")
    return f"""
WITH gram AS (SELECT count(*) AS n, {gram} FROM embeddings),
t AS ({' UNION ALL '.join(parts)}),
p AS (SELECT *, {_f_tail_sql('(t * t)', '1', 'dof')} AS p FROM t),
{', '.join(rounds)}
{' UNION ALL '.join(f"SELECT step, variable, {_r('t', 4)} AS t, {_r('p')} AS p FROM r{i}" for i in range(1, len(OLS_X)))}
"""


@register("backward_ols_rounds", _ols_rounds_sql())
def q_backward_ols_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward elimination as it goes: the column dropped in each round, its t and p at that time."""
    from varkit.operators.reduce import backward_steps
    emb = _emb_frame(spark, sf_dir).select(OLS_Y, *OLS_X)
    rows = [(i, c, t, p) for i, (c, t, p) in enumerate(backward_steps(emb, OLS_Y, alpha=OLS_ALPHA), 1)]
    out = spark.createDataFrame(rows, "step int, variable string, t double, p double")
    return rounded(out.withColumn("t", F.round("t", 4)))


# ---- rounds of the VIF reductions over three of the derived columns
VIF_ROUND_COLS = ("price", "revenue", "qty")


def _vif_rounds_sql(centred: bool) -> str:
    a, b, c = VIF_ROUND_COLS
    m = (lambda x, y: f"corr({x}, {y})") if centred else (lambda x, y: f"sum({x} * {y}) / sqrt(sum({x} * {x}) * sum({y} * {y}))")
    two = lambda x, y: f"1 / (1 - {x}{y} * {x}{y})"
    det = "(1 - ab * ab - ac * ac - bc * bc + 2 * ab * ac * bc)"
    return f"""
WITH base AS (SELECT l_extendedprice AS price, l_extendedprice * (1 - l_discount) AS revenue, l_quantity AS qty FROM lineitem),
m AS (SELECT {m(a, b)} AS ab, {m(a, c)} AS ac, {m(b, c)} AS bc FROM base),
f1 AS (
  SELECT 0 AS i, '{a}' AS variable, (1 - bc * bc) / {det} AS vif FROM m UNION ALL SELECT 1, '{b}', (1 - ac * ac) / {det} FROM m
  UNION ALL SELECT 2, '{c}', (1 - ab * ab) / {det} FROM m
), r1 AS (SELECT * FROM f1 WHERE vif > 2.5 ORDER BY vif DESC, i LIMIT 1),
f2 AS (
  SELECT CASE WHEN i = 0 THEN 1 ELSE 0 END AS i, CASE WHEN i = 0 THEN '{b}' ELSE '{a}' END AS variable,
    CASE i WHEN 0 THEN {two('b', 'c')} WHEN 1 THEN {two('a', 'c')} ELSE {two('a', 'b')} END AS vif FROM r1, m
), r2 AS (SELECT * FROM f2 WHERE vif > 2.5)
SELECT 1 AS step, variable, {_r('vif', 4)} AS vif FROM r1 UNION ALL SELECT 2, variable, {_r('vif', 4)} FROM r2
"""


def _vif_rounds_frame(spark: SparkSession, sf_dir: str, centred: bool) -> DataFrame:
    from varkit.operators.reduce import vif_rounds
    rounds = vif_rounds(_red_frame(spark, sf_dir).select(*VIF_ROUND_COLS), 2.5, centred=centred)
    out = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(rounds, 1)], "step int, variable string, vif double")
    return rounded(out, 4)


@register("vif_rounds", _vif_rounds_sql(False))
def q_vif_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uncentred VIF reduction as it goes: the column dropped in each round and its VIF at that time."""
    return _vif_rounds_frame(spark, sf_dir, False)


@register("vif_rounds_corr", _vif_rounds_sql(True))
def q_vif_rounds_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on correlations."""
    return _vif_rounds_frame(spark, sf_dir, True)


@register("collinear_shares", f"""
WITH base AS (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_tax AS DOUBLE) AS t, CAST(l_quantity AS DOUBLE) + 100 * CAST(l_tax AS DOUBLE) AS s,
    CAST(l_discount AS DOUBLE) AS d FROM lineitem),
g AS (SELECT sum(q * q) AS qq, sum(q * t) AS qt, sum(t * t) AS tt, sum(q * d) AS qd, sum(t * d) AS td, sum(d * d) AS dd FROM base),
r AS (SELECT *, sqrt(tt - qt * qt / qq) AS rt, (td - qt * qd / qq) / sqrt(tt - qt * qt / qq) AS rtd FROM g)
SELECT 'l_quantity' AS variable, 1.0 AS share, false AS dependent FROM r
UNION ALL SELECT 'l_tax', {_r('rt / sqrt(tt)')}, false FROM r
UNION ALL SELECT 'qty_tax', 0.0, true FROM r
UNION ALL SELECT 'l_discount', {_r('sqrt(dd - qd * qd / qq - rtd * rtd) / sqrt(dd)')}, false FROM r
""")
def q_collinear_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per column, from the triangular factor of the table: the share of its length outside the columns before
    it, and whether it is a combination of them (``qty_tax`` is one)."""
    from varkit.operators.qr import dependent_columns, pivot_shares, r_factor
    li = read_table(spark, sf_dir, "lineitem", ["l_quantity", "l_tax", "l_discount"])
    li = li.select("l_quantity", "l_tax", (F.col("l_quantity") + 100 * F.col("l_tax")).alias("qty_tax"), "l_discount")
    names = li.columns
    r = r_factor(li, names)
    gone = dependent_columns(r)
    kept = [j for j in range(len(names)) if j not in gone]
    shares = pivot_shares(r)
    for place, j in enumerate(kept):
        shares[j] = pivot_shares(_upper(r[:, kept[:place + 1]]))[-1]
    rows = [(n, float(shares[j]), j in gone) for j, n in enumerate(names)]
    return rounded(spark.createDataFrame(rows, "variable string, share double, dependent boolean"))


def _upper(r):
    import numpy as np
    return np.linalg.qr(r, mode="r")


# ------------------------------------------------------------------ scoring
def _orders_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
                                             "o_orderdate"])
    return o.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("event_prob"),
                    (F.col("o_orderstatus") == "F").cast("int").alias("target_flag"),
                    F.col("o_orderpriority").alias("snapshot"))


SPLIT_DATE = "1998-04-01 00:00:00"

_GAINS_SQL = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY event_prob DESC, o_orderkey) AS rk,
    ceil(count(*) OVER () / 10.0) AS step FROM {src}
), b AS (
  SELECT *, CAST(floor(rk / step) + 1 AS INTEGER) AS bucket FROM ranked
), bounds AS (
  SELECT bucket, min(event_prob) AS min_prob, max(event_prob) AS max_prob FROM b GROUP BY bucket
), cells AS (
  SELECT bucket, snapshot, count(*) AS counts, CAST(sum(target_flag) AS BIGINT) AS events
  FROM b GROUP BY bucket, snapshot
)"""


@register("gains_table", "WITH base AS (SELECT o_orderkey, o_totalprice AS event_prob, "
          "CAST(o_orderstatus = 'F' AS INTEGER) AS target_flag, o_orderpriority AS snapshot FROM orders),"
          + _GAINS_SQL.replace("{src}", "base") + f"""
SELECT c.bucket, c.snapshot, {_r('bo.min_prob')} AS min_prob, {_r('bo.max_prob')} AS max_prob, c.counts, c.events
FROM cells c JOIN bounds bo USING (bucket)
""")
def q_gains_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.score import gains_table
    table, _ = gains_table(_orders_scored(spark, sf_dir), "event_prob", "target_flag", "snapshot", "o_orderkey")
    return rounded(table)


@register("match_buckets", "WITH base AS (SELECT o_orderkey, o_totalprice AS event_prob, "
          "CAST(o_orderstatus = 'F' AS INTEGER) AS target_flag, o_orderpriority AS snapshot FROM orders "
          f"WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}'), test AS (SELECT o_totalprice AS event_prob, "
          "CAST(o_orderstatus = 'F' AS INTEGER) AS target_flag, o_orderpriority AS snapshot FROM orders "
          f"WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}'),"
          + _GAINS_SQL.replace("{src}", "base") + f""",
tm AS (
  SELECT t.*, coalesce((SELECT min(bucket) FROM bounds WHERE t.event_prob >= bounds.min_prob),
    CASE WHEN t.event_prob <= (SELECT min_prob FROM bounds WHERE bucket = 10) THEN 10 END) AS train_bucket
  FROM test t
), tg AS (
  SELECT train_bucket, snapshot, count(*) AS count_test, CAST(sum(target_flag) AS BIGINT) AS events_test
  FROM tm GROUP BY train_bucket, snapshot
)
SELECT c.bucket, c.snapshot, {_r('bo.min_prob')} AS min_prob, {_r('bo.max_prob')} AS max_prob,
  c.counts AS count_train, c.events AS events_train, tg.count_test, tg.events_test
FROM cells c JOIN bounds bo USING (bucket)
LEFT JOIN tg ON tg.train_bucket = c.bucket AND tg.snapshot = c.snapshot
""")
def q_match_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.score import gains_table, match_buckets
    o = _orders_scored(spark, sf_dir)
    # train on the earlier orders, test on the later ones (together: the whole table)
    split = F.lit(SPLIT_DATE).cast(o.schema["o_orderdate"].dataType)
    train = o.where(F.col("o_orderdate") < split)
    test = o.where(F.col("o_orderdate") >= split)
    table, bounds = gains_table(train, "event_prob", "target_flag", "snapshot", "o_orderkey")
    return rounded(match_buckets(table, bounds, test, "event_prob", "target_flag", "snapshot"))


#: The defaults (70 trees of depth 6) but for the smallest leaf, which at 600000 rows needs larger tables than these.
GBT_LEAF = dict(minInstancesPerNode=5, seed=7)


@register("gbt_scores")
def q_gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.score import fit_gbt, score_event_prob
    df = _doc_features(spark, sf_dir)
    # fitted on the labelled rows, applied to every document
    model = fit_gbt(df.where("quality IS NOT NULL"), DOC_FEATURES, "quality", **GBT_LEAF)
    return score_event_prob(model, df, keep=["doc_id", "quality"])


@register("feature_importance")
def q_feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varkit.operators.score import feature_importance, fit_gbt
    df = _doc_features(spark, sf_dir).where("quality IS NOT NULL")
    model = fit_gbt(df, DOC_FEATURES, "quality", **GBT_LEAF)
    return feature_importance(spark, model, DOC_FEATURES)


@register("vif_reduction")
def q_vif_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterative uncentred-VIF reduction over the derived lineitem variables (rows-only check;
    the per-round VIF is checked by ``vif``)."""
    from varkit.operators.reduce import vif_reduction
    dropped = vif_reduction(_red_frame(spark, sf_dir), limit=2.5)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(dropped)], "step int, variable string")


@register("vif_reduction_corr")
def q_vif_reduction_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collinear columns first, then centred-VIF reduction (rows-only check; the centred VIF
    is checked by ``vif_corr``)."""
    from varkit.operators.reduce import vif_reduction_corr
    dropped = vif_reduction_corr(_red_frame(spark, sf_dir), limit=2.5)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(dropped)], "step int, variable string")
