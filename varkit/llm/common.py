"""Helpers shared by the operators: shared scratch tables, worker caches, prefix sums."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's ``spark.checkpoint.dir``, which driver and executors
    share.  Only where that is unset (single-machine tests) a local folder is set instead."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="varkit-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/varkit-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch space and read it back: the lineage is cut, a lost
    executor costs no recomputation, and row ids made while writing stay fixed."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process, whatever is unpickled in it."""
    mod = sys.modules.get("_varkit_llm_worker")
    if mod is None:
        mod = sys.modules["_varkit_llm_worker"] = types.ModuleType("_varkit_llm_worker")
        mod.store = {}
    return mod.store


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def word_count(col):
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str,
                name: str = "prefix") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before
    in the order ``order``, and ``_part``, ``_rid`` (a row id, fixed by writing the table).

    No group is gathered in one task: rows are range-partitioned by (group, order) and written,
    totals per (range, group) are one small row each, and the window that adds up inside a
    range sees one range's rows only.  NULL is a group of its own.  Rows equal in ``order``
    keep a fixed but arbitrary order among themselves.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(n, F.col(group).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order])
    rows = stored(spread.withColumn("_part", F.spark_partition_id())
                  .withColumn("_rid", F.monotonically_increasing_id()), name)
    totals = rows.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("_part").alias("_bp"), F.col(group).alias("_bg"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = (Window.partitionBy("_part", group).orderBy(*[F.col(c).asc_nulls_first() for c in order], "_rid")
              .rowsBetween(Window.unboundedPreceding, -1))
    local = rows.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (local.join(base, (local["_part"] == base["_bp"]) & local[group].eqNullSafe(base["_bg"]))
            .withColumn(out, (F.col("_base") + F.col("_local")).cast("long"))
            .drop("_bp", "_bg", "_base", "_local"))
