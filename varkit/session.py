"""Session helpers for tests, the bench and the examples."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "varkit") -> SparkSession:
    spark = (SparkSession.builder.master(master).appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             # keep wide one-pass aggregates (many variables at once) in generated code
             .config("spark.sql.codegen.maxFields", "1000")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
