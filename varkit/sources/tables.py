"""Table access and result sinks.

The toolkit reads no file format of its own: operators take DataFrames.  These
helpers load the parquet tables the examples and checks use (selecting only
the needed columns, so the scan's ReadSchema is pruned) and write results with
Spark's own writers.  Spark ML model save/load lives in
``varkit.operators.score``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, cols=None) -> DataFrame:
    """Read one parquet table; ``cols`` prunes the scan to those columns."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by=None) -> None:
    """Write an operator result with a Spark writer (parquet, csv, json, orc).

    The reference wrote spreadsheets; results here are ordinary DataFrames, so
    any Spark sink works.  CSV gets a header row.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", "true")
    w.format(fmt).save(path)
