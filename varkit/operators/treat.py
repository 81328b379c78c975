"""Outlier treatment and category encoding.

* :func:`cap_floor` - values above ``a`` become ``a``, then values below ``b``
  become ``b``; NULL stays NULL.  Map-only.
* :func:`dummies` - 0/1 column per category except the least frequent; :func:`dummies_sparse` the same
  as one sparse vector, for any number of categories.
* :func:`dummies_binary` - each category's frequency rank written in base 2,
  one 0/1 column per binary digit (least significant first).
* :func:`smooth_tails` - recursive exponential smoothing of the values above
  p99 (and below p1), seeded from the values in [p95, p99] (and [p1, p5]).

Frequency order everywhere: count descending, then category ascending, NULL
last (a fixed tie rule).  The NULL category is counted but never matches, so
its indicator columns are all zero.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from varkit.functions.columns import qcol
from varkit.operators.profile import bracketed_percentiles
from varkit.operators.rank import with_positions


def _is_float(df: DataFrame, s: str) -> bool:
    return isinstance(df.schema[s].dataType, (T.FloatType, T.DoubleType))


def cap_floor(df: DataFrame, s: str, a, b, high: bool = True, low: bool = True) -> DataFrame:
    """Cap ``s`` at ``a`` (when ``high``), then floor it at ``b`` (when ``low``).  NULL and NaN are
    missing values and stay as they are."""
    c = qcol(s)
    if high:
        over = c > F.lit(a)
        if _is_float(df, s):
            over = over & ~F.isnan(c)
        c = F.when(over, F.lit(a)).otherwise(c)
    if low:
        c = F.when(c < F.lit(b), F.lit(b)).otherwise(c)
    return df.select(*[c.alias(s) if n == s else qcol(n) for n in df.columns])


#: A category with more rows than this is hot: its code is broadcast, so that no shuffle gathers its rows.
HOT_ROWS = 1_000_000


def category_codes(df: DataFrame, s: str) -> DataFrame:
    """``category, n, code``: every category with its rows and its rank in frequency order (count desc, category
    asc, NULL last), from 0.  Counts are one aggregate; ranks come from range cuts of the count table, so any number
    of categories stays distributed."""
    counts = df.groupBy(qcol(s).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.withColumn("_less", -F.col("n")).withColumn("_null", F.col("category").isNull().cast("int"))
    return with_positions(ordered, [], ["_less", "_null", "category"], out="code").select("category", "n", "code")


def with_codes(df: DataFrame, s: str, codes: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the code of the row's category, NULL for a NULL category.

    Codes are an equi-join.  Hot categories (at most rows / ``HOT_ROWS`` of them) are a broadcast join of their own,
    so that the shuffled join only sees keys of a bounded number of rows.
    """
    named = codes.where(F.col("category").isNotNull()).select(F.col("category").alias("_category"), F.col("code").alias(out), "n")
    hot, rest = named.where(F.col("n") > HOT_ROWS).drop("n"), named.where(F.col("n") <= HOT_ROWS).drop("n")
    first = hot.select("_category", F.col(out).alias("_hot_code"))
    if first.isEmpty():
        return df.join(rest, qcol(s) == F.col("_category"), "left").drop("_category")
    marked = df.join(F.broadcast(first), qcol(s) == F.col("_category"), "left").drop("_category")
    cold = marked.where(F.col("_hot_code").isNull()).drop("_hot_code").join(rest, qcol(s) == F.col("_category"), "left").drop("_category")
    return cold.unionByName(marked.where(F.col("_hot_code").isNotNull()).withColumnRenamed("_hot_code", out))


def _suffix(cat) -> str:
    return "null" if cat is None else str(cat)


def _free_names(names: list[str], taken: Sequence[str]) -> list[str]:
    """The names, with ``_2``, ``_3`` ... where one is equal to another but for case (Spark can't tell them apart)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        free, n = name, 1
        while free.lower() in used:
            n += 1
            free = f"{name}_{n}"
        used.add(free.lower())
        out.append(free)
    return out


def dummies(df: DataFrame, s: str) -> tuple[DataFrame, list]:
    """One-hot columns ``{s}_dum_{category}`` for all categories but the least
    frequent; returns the new DataFrame and the encoded categories, most
    frequent first.  The categories are column names here, so they are collected; for categories in numbers
    that no schema should hold there is :func:`dummies_sparse`."""
    cats = [r["category"] for r in category_codes(df, s).orderBy("code").collect()][:-1]
    cols = [qcol(n) for n in df.columns]
    names = _free_names([f"{s}_dum_{_suffix(cat)}" for cat in cats], df.columns)
    for cat, name in zip(cats, names):
        hit = F.lit(False) if cat is None else (qcol(s) == F.lit(cat))
        cols.append(F.when(hit, F.lit(1)).otherwise(F.lit(0)).alias(name))
    return df.select(*cols), cats


def dummies_sparse(df: DataFrame, s: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The one-hot encoding as one sparse vector column ``{s}_dum`` (element k is the k-th most frequent category; the
    least frequent one and NULL have none), and the code table of :func:`category_codes`.  Neither the
    categories nor a map of them ever reach the driver or a plan."""
    from pyspark.ml.feature import OneHotEncoder
    out = out or f"{s}_dum"
    codes = category_codes(df, s)
    last = (codes.agg(F.max("code")).collect()[0][0] or 0)
    # the encoder leaves out its last number, which here stands for the least frequent category and for NULL
    place = F.when(F.col("_code") < last, F.col("_code")).otherwise(max(last, 1)).cast("double")
    coded = with_codes(df, s, codes, "_code").withColumn("_code", place)
    sizes = df.sparkSession.createDataFrame([(float(max(last, 1)),)], "_code double")
    encoder = OneHotEncoder(inputCols=["_code"], outputCols=[out], dropLast=True).fit(sizes)
    return encoder.transform(coded).drop("_code"), codes


def dummies_binary(df: DataFrame, s: str) -> tuple[DataFrame, DataFrame]:
    """Binary codes: the k-th most frequent category (0-based) gets code k; column
    ``{s}_dum_j`` holds bit j of the code.  The number of columns is the number
    of binary digits of the category count.  Returns the DataFrame and the conversion table
    ``category, n, code, digits`` (the code written in base 2)."""
    codes = category_codes(df, s)
    ndig = len(bin(codes.count())) - 2
    coded = with_codes(df, s, codes, "_code")
    cols = [qcol(n) for n in df.columns]
    for j in range(ndig):
        bit = F.coalesce(F.shiftright("_code", j).bitwiseAND(F.lit(1)), F.lit(0))
        cols.append(bit.cast("int").alias(f"{s}_dum_{j}"))
    return coded.select(*cols), codes.withColumn("digits", F.bin("code"))


# --------------------------------------------------------------- tail smoothing
#: Rows of a block of the chained recurrence, whatever alpha is.
BLOCK_ROWS = 100_000


def _decay_block(alpha: float) -> int:
    """Rows after which an earlier state has decayed below 2**-500 relative; up to so many the
    in-block scale (1-alpha)**-n stays far from overflow."""
    return max(1, int(500.0 / -math.log2(1.0 - alpha)))


def _chain(tail: DataFrame, s: str, pos: str, alpha: float, seed: float) -> DataFrame:
    """Apply x'_k = alpha*x_k + (1-alpha)*x'_{k-1}, x'_0 = seed, along 1-based ``pos``.

    Each step is an affine map of the state, and so is a block of n rows: state -> (1-a)^n * state + c with
    c = a * sum_j (1-a)^(n-j) t_j.  Block maps are one aggregate; composing them in order gives the state that
    enters every block.  Inside a block the state after row u is (1-a)^u * (entering + a * sum_{j<=u} (1-a)^-j t_j),
    a window per block.  Blocks have ``BLOCK_ROWS`` rows, fewer where the scale (1-a)^-n would overflow: then
    what enters a block is decided by the block before it alone, a join one block forward; else the maps, one
    row per ``BLOCK_ROWS`` tail rows, are composed on the driver.
    """
    lq = math.log1p(-alpha)
    forgets = _decay_block(alpha)
    n = min(BLOCK_ROWS, forgets)
    t = (tail.withColumn("_blk", F.floor((F.col(pos) - 1) / n).cast("long"))
             .withColumn("_u", (F.col(pos) - F.col("_blk") * n).cast("double")))
    # every block but the last is full, so c can be summed with the scale of a full block and put right afterwards
    maps = t.groupBy("_blk").agg(F.max("_u").alias("_nb"), F.sum(F.lit(alpha) * F.exp(F.lit(lq) * (F.lit(float(n)) - F.col("_u"))) * qcol(s)).alias("_c"))
    maps = maps.withColumn("_c", F.col("_c") * F.exp(F.lit(lq) * (F.col("_nb") - F.lit(float(n)))))
    spark = tail.sparkSession
    if n == forgets:
        carry = maps.select((F.col("_blk") + 1).alias("_blk"),
                            (F.col("_c") + F.when(F.col("_blk") == 0, F.exp(F.lit(lq) * F.col("_nb")) * F.lit(seed))
                             .otherwise(F.lit(0.0))).alias("_carry"))
        carry = carry.unionByName(spark.createDataFrame([(0, float(seed))], "_blk long, _carry double"))
    else:
        state, entering = float(seed), []
        for r in sorted(maps.collect(), key=lambda r: r["_blk"]):
            entering.append((r["_blk"], state))
            state = math.exp(lq * r["_nb"]) * state + r["_c"]
        carry = spark.createDataFrame(entering, "_blk long, _carry double")
    w = Window.partitionBy("_blk").orderBy("_u").rowsBetween(Window.unboundedPreceding, 0)
    run = t.withColumn("_S", F.sum(F.exp(F.lit(-lq) * F.col("_u")) * qcol(s)).over(w))
    run = run.join(carry, "_blk", "left")
    val = F.exp(F.lit(lq) * F.col("_u")) * (F.col("_carry") + F.lit(alpha) * F.col("_S"))
    return run.withColumn(s, val).drop("_blk", "_u", "_S", "_carry")


def smooth_tails(df: DataFrame, s: str, key: str, alpha: float = .5,
                 high: bool = True, low: bool = True) -> DataFrame:
    """Exponential smoothing of the tails of ``s``.

    High side: seed = fold over the values in [p95, p99] ascending
    (s = a0; s = alpha*a + (1-alpha)*s), then every value above p99, ascending,
    becomes alpha*x + (1-alpha)*previous.  Low side: seed from the values in
    [p1, p5] (start at the largest, fold from the largest down to the third
    smallest), then the values below p1 in descending order.  ``key`` (a unique
    column) orders equal values.  An empty seed band leaves that tail unchanged.
    The flags are independent.  Rows outside the tails pass through map-only.
    """
    if alpha <= 0 or alpha >= 1:
        raise ValueError(f"smoothing factor alpha must lie strictly inside (0, 1), got {alpha}")
    x = qcol(s)
    if _is_float(df, s):
        # NaN is a missing value: such rows pass through and take no part in the percentiles
        real = df.where(~F.coalesce(F.isnan(x), F.lit(False)))
        missing = df.where(F.coalesce(F.isnan(x), F.lit(False)))
    else:
        real, missing = df, None
    whole, df = df, real
    n = df.agg(F.count(x)).collect()[0][0]
    if not n:
        return whole
    p1, p5, p95, p99 = bracketed_percentiles(df.select(x.cast("double").alias("value")), [], "value", (.01, .05, .95, .99), {(): int(n)})[()]
    # sizes of the two seed bands and the two tails, in one pass (hints for the ranks)
    sz = df.agg(F.count(F.when(x.between(F.lit(p95), F.lit(p99)), 1)).alias("hb"),
                F.count(F.when(x > F.lit(p99), 1)).alias("ht"),
                F.count(F.when(x.between(F.lit(p1), F.lit(p5)), 1)).alias("lb"),
                F.count(F.when(x < F.lit(p1), 1)).alias("lt")).collect()[0]
    cols = df.columns
    keep = df
    parts = []
    if high and sz["hb"] > 0 and sz["ht"] > 0:
        seed = _high_seed(df.where(x.between(F.lit(p95), F.lit(p99))), s, key, alpha, sz["hb"])
        keep = keep.where(~(x > F.lit(p99)) | x.isNull())
        tail = with_positions(df.where(x > F.lit(p99)), [], [s, key], out="_p", max_group_rows=sz["ht"])
        tail = tail.withColumn("_p", F.col("_p") + 1)
        parts.append(_chain(tail, s, "_p", alpha, seed).select(*cols))
    if low and sz["lb"] > 0 and sz["lt"] > 0:
        seed = _low_seed(df.where(x.between(F.lit(p1), F.lit(p5))), s, key, alpha, sz["lb"])
        keep = keep.where(~(x < F.lit(p1)) | x.isNull())
        tail = with_positions(df.where(x < F.lit(p1)), [], [s, key], out="_p", max_group_rows=sz["lt"])
        tail = tail.withColumn("_p", F.lit(sz["lt"]) - F.col("_p"))  # from the largest down
        parts.append(_chain(tail, s, "_p", alpha, seed).select(*cols))
    out = keep
    for part in parts + [missing] * (missing is not None):
        out = out.unionByName(part)
    return out


def _high_seed(band: DataFrame, s: str, key: str, alpha: float, m: int) -> float:
    """sum_i w_i a_i with w_0 = (1-a)^(m-1), w_i = a(1-a)^(m-1-i): the fold in closed form."""
    pos = with_positions(band, [], [s, key], out="_i", max_group_rows=m)
    lq = math.log1p(-alpha)
    w = F.when(F.col("_i") == 0, F.exp(F.lit(lq) * (m - 1))).otherwise(
        F.lit(alpha) * F.exp(F.lit(lq) * (F.lit(m - 1) - F.col("_i"))))
    return pos.agg(F.sum(w * qcol(s))).collect()[0][0]


def _low_seed(band: DataFrame, s: str, key: str, alpha: float, m: int) -> float:
    """Closed form of the low-side seed loop (start at the largest value, fold the
    elements from the largest down to the third smallest)."""
    pos = with_positions(band, [], [s, key], out="_i", max_group_rows=m)
    if m <= 2:
        return pos.where(F.col("_i") == m - 1).agg(F.max(qcol(s))).collect()[0][0]
    lq = math.log1p(-alpha)
    top = math.exp(lq * (m - 2)) + alpha * math.exp(lq * (m - 3))
    w = (F.when(F.col("_i") == m - 1, F.lit(top))
          .when(F.col("_i") >= 2, F.lit(alpha) * F.exp(F.lit(lq) * (F.col("_i") - 2)))
          .otherwise(F.lit(0.0)))
    return pos.agg(F.sum(w * qcol(s))).collect()[0][0]
