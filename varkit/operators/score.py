"""Model scores to gains tables.

* :func:`fit_gbt` - ``VectorAssembler`` + ``GBTClassifier`` in a Spark ML
  ``Pipeline`` (save / load with the ML writers).
* :func:`score_event_prob` - probability of class 1 with the built-in
  ``vector_to_array`` (no Python UDF).
* :func:`gains_table` - rank by score (descending, ties by a key), cut into
  deciles of ``ceil(n/10)`` rows (bucket = floor(rank/step)+1), score range per
  bucket, counts and events per bucket x snapshot.
* :func:`match_buckets` - put each test row into the train bucket whose score
  range covers it and compare counts and events side by side.

The global rank never runs as an unpartitioned window: the at most 11 decile
boundary rows are found as exact order statistics
(:func:`varkit.operators.brackets.order_statistics` on the scores, then
:func:`varkit.operators.rank.select_positions` on the key within a tied score), and every row's bucket is then a map-side
comparison against those boundaries.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varkit.functions.columns import qcol
from varkit.operators.brackets import order_statistics
from varkit.operators.rank import select_positions

GBT_DEFAULTS = dict(maxIter=70, maxDepth=6, minInstancesPerNode=600000,
                    featureSubsetStrategy="sqrt", stepSize=1.0)


def fit_gbt(df: DataFrame, features: Sequence[str], target: str, **params):
    """Fit assembler + gradient-boosted trees; returns a ``PipelineModel``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    conf = dict(GBT_DEFAULTS)
    conf.update(params)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol=target, featuresCol="features", **conf)
    return Pipeline(stages=[assembler, gbt]).fit(df)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def score_event_prob(model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus ``event_prob`` (probability of class 1)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.select(*[qcol(c) for c in keep],
                      vector_to_array(F.col("probability"))[1].alias("event_prob"))


def feature_importance(spark, model, features: Sequence[str]) -> DataFrame:
    """``Variable, Importance`` in input order, from the fitted trees."""
    gbt = model.stages[-1] if hasattr(model, "stages") else model
    imp = gbt.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                 "Variable string, Importance double")


# ------------------------------------------------------------------ deciles
def _boundaries(df: DataFrame, score: str, key: str, positions: list[int], n: int) -> list[tuple]:
    """(score, key) of the rows at the given 0-based positions of the order
    score desc, key asc.  Two exact selections: on the scores by brackets, then on the key inside each
    tied score.  The score column is a double without NULL and NaN."""
    if not positions:
        return []
    spark = df.sparkSession
    at = order_statistics(df.select((-qcol(score)).alias("_neg")), [], "_neg", {(): positions}, {(): n})
    first = [at[(), p] for p in positions]
    level2 = [(j, -s.value, int(p - s.before)) for j, (p, s) in enumerate(zip(positions, first))]
    stype = df.schema[score].dataType.simpleString()
    tg2 = spark.createDataFrame(level2, f"_j int, _s {stype}, _pos long")
    rows = df.select(qcol(score).alias("_s"), qcol(key).alias("_k")).join(
        F.broadcast(tg2.select("_s").distinct()), "_s", "left_semi")
    # a tied score holds at most as many rows as its weight; the largest is a bound
    biggest = max((s.rows for s in first), default=0)
    second = select_positions(rows, ["_s"], "_k", None, tg2, pos="_pos",
                              max_group_rows=biggest).collect()
    got = {r["_j"]: (r["_s"], r["_k"]) for r in second}
    return [got[j] for j in range(len(positions))]


def decile_bucket(score: Column, key: Column, bounds: list[tuple]) -> Column:
    """1 + number of boundary rows at or before this row in (score desc, key asc)."""
    b = F.lit(1)
    for s, k in bounds:
        after = (score < F.lit(s)) | ((score == F.lit(s)) & (key >= F.lit(k)))
        b = b + after.cast("int")
    return b


def gains_table(df: DataFrame, score: str, target: str, snapshot: str, key: str,
                n_buckets: int = 10) -> tuple[DataFrame, DataFrame]:
    """Returns ``(table, bounds)``.

    ``table``: ``bucket, snapshot, min_prob, max_prob, counts, events``;
    ``bounds``: ``bucket, min_prob, max_prob``.  ``key`` must be unique; it
    orders rows with equal scores.  The scores are compared as doubles.
    """
    # missing scores (NULL, NaN) rank last, below every number, and stay out of min_prob and max_prob
    p = F.nanvl(qcol(score).cast("double"), F.lit(None).cast("double"))
    df = df.select(p.alias("_p"), F.coalesce(p, F.lit(float("-inf"))).alias("_rank"), qcol(key).alias("_key"),
                   qcol(snapshot).alias("snapshot"), qcol(target).alias("_t"))
    n = df.count()
    step = math.ceil(n / n_buckets) if n else 1
    positions = [step * j - 1 for j in range(1, n // step + 1)] if n else []
    bounds = _boundaries(df, "_rank", "_key", positions, n)
    scored = df.select(decile_bucket(F.col("_rank"), F.col("_key"), bounds).alias("bucket"), "snapshot", "_p", "_t")
    cells = scored.groupBy("bucket", "snapshot").agg(
        F.min("_p").alias("_mn"), F.max("_p").alias("_mx"),
        F.count(F.lit(1)).alias("counts"), F.sum("_t").alias("events"))
    rng = cells.groupBy("bucket").agg(F.min("_mn").alias("min_prob"), F.max("_mx").alias("max_prob"))
    table = cells.join(F.broadcast(rng), "bucket").select(
        "bucket", "snapshot", "min_prob", "max_prob", "counts", "events")
    return table, rng


def match_buckets(train_table: DataFrame, train_bounds: DataFrame, test: DataFrame, score: str,
                  target: str, snapshot: str, fallback_bucket: int = 10) -> DataFrame:
    """Side-by-side train/test gains table.

    A test row goes to the lowest-numbered train bucket whose ``min_prob`` is at
    most its score; below every bound it goes to bucket ``fallback_bucket`` if
    its score is at most that bucket's ``min_prob`` (the lowest-score bucket
    present when bucket ``fallback_bucket`` does not exist), else nowhere.  A missing score (NULL, NaN)
    goes to the last train bucket, where :func:`gains_table` ranks such rows.
    The bounds are at most ``n_buckets + 1`` rows, so the lookup is a literal
    CASE chain: map-only, no range join.
    """
    bounds = sorted((int(r["bucket"]), r["min_prob"]) for r in train_bounds.collect())
    p = F.nanvl(qcol(score).cast("double"), F.lit(None).cast("double"))
    chain = F.when(p.isNull(), F.lit(bounds[-1][0])) if bounds else None
    for b, mn in bounds:
        chain = chain.when(p >= F.lit(mn), F.lit(b))
    present = dict(bounds)
    fb = fallback_bucket if fallback_bucket in present else (max(present) if present else None)
    if chain is None:
        tb = F.lit(None).cast("int")
    else:
        tb = chain.when(p <= F.lit(present[fb]), F.lit(fb)) if fb is not None else chain
    test_groups = (test.select(tb.alias("train_bucket"), qcol(snapshot).alias("snapshot"),
                               qcol(target).alias("_t"))
                   .groupBy("train_bucket", "snapshot")
                   .agg(F.count(F.lit(1)).alias("count_test"), F.sum("_t").alias("events_test")))
    a = train_table.alias("a")
    t = test_groups.alias("b")
    j = a.join(t, (F.col("a.bucket") == F.col("b.train_bucket")) & (F.col("a.snapshot") == F.col("b.snapshot")),
               "left")
    return j.select(F.col("a.bucket").alias("bucket"), F.col("a.snapshot").alias("snapshot"),
                    "a.min_prob", "a.max_prob", F.col("a.counts").alias("count_train"),
                    F.col("a.events").alias("events_train"), "b.count_test", "b.events_test")
