"""Intermediates shared by the jobs of one summary operator.

Summary operators (profile, trend tables) run a few small driver-side steps
(counts, boundaries) and a final aggregate, all over the same distinct-value
table.  That table is persisted (memory, spilling to disk) for the call, the
small result (one row per variable or per bucket) is collected, and the cache
is released.  A lost cached block is recomputed from its deterministic lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class Scratch:
    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.frames.append(df)
        return df

    def release(self) -> None:
        for f in self.frames:
            f.unpersist()
        self.frames.clear()

    def finish(self, result: DataFrame) -> DataFrame:
        """Collect the (small) result, release the cache, return it as a DataFrame."""
        try:
            rows = result.collect()
            return result.sparkSession.createDataFrame(rows, result.schema)
        finally:
            self.release()


# Aggregation-buffer fields per aggregate (Spark's declarative aggregates).
FIELDS = {"count": 1, "sum": 1, "min": 1, "max": 1, "avg": 2, "stddev": 3, "var": 3,
          "skewness": 4, "kurtosis": 5, "covar": 4, "corr": 6}
MAX_FIELDS_CONF = "spark.sql.codegen.maxFields"


def wide_agg(df: DataFrame, aggs: list[tuple]) -> dict:
    """Global aggregate of ``[(column, kind), ...]`` returned as one dict.

    Whole-stage code generation is switched off for a plan whose buffers have
    more than ``spark.sql.codegen.maxFields`` fields, and the interpreted
    aggregate is several times slower.  The aggregates are therefore grouped
    into passes that stay under the session's limit: one pass when the
    session allows wide buffers, a few codegen'd passes otherwise.
    """
    budget = max(8, int(df.sparkSession.conf.get(MAX_FIELDS_CONF, "100")) - 4)
    out: dict = {}
    # aggregates wider than the limit on their own share one (interpreted) pass
    oversized = [c for c, kind in aggs if FIELDS.get(kind, 8) > budget]
    if oversized:
        out.update(df.agg(*oversized).collect()[0].asDict())
    chunk: list = []
    used = 0
    for col, kind in [(c, k) for c, k in aggs if FIELDS.get(k, 8) <= budget]:
        f = FIELDS.get(kind, 8)
        if chunk and used + f > budget:
            out.update(df.agg(*chunk).collect()[0].asDict())
            chunk, used = [], 0
        chunk.append(col)
        used += f
    if chunk:
        out.update(df.agg(*chunk).collect()[0].asDict())
    return out
