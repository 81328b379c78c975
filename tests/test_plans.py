"""Scale rules checked on physical plans, on the bucketed (large-table) path."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import SF_ORACLE, SF_SMALL
from varkit.plans.guards import assert_no_single_partition, assert_pruned_scan, physical_plan, recorded_plans


def test_no_single_partition(spark, bucketed):
    from varkit.plans.catalog import QUERIES
    for name in ("profile_numeric", "profile_categorical", "trends_numeric", "binned_line", "box_stats",
                 "smooth_tails", "gains_table", "match_buckets", "dummies_binary"):
        with recorded_plans() as plans:
            QUERIES[name](spark, SF_SMALL).collect()
        assert any("FileScan" in p for p in plans), name
        assert_no_single_partition(plans)


def test_scan_is_pruned(spark):
    from varkit.plans.catalog import QUERIES
    for name, table, columns in (("profile_numeric", "lineitem", {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}),
                                 ("trends_numeric", "customer", {"c_acctbal", "c_mktsegment"})):
        with recorded_plans() as plans:
            QUERIES[name](spark, SF_SMALL).collect()
        assert_pruned_scan(plans, table, columns)


def test_the_guards_see_faults(spark):
    df = spark.read.parquet(SF_SMALL + "/customer.parquet")
    with recorded_plans() as plans:
        df.select("c_custkey", F.row_number().over(Window.orderBy("c_custkey"))).collect()
    with pytest.raises(AssertionError, match="SinglePartition"):
        assert_no_single_partition(plans)
    with pytest.raises(AssertionError, match="reads"):
        assert_pruned_scan(plans, "customer", {"c_name"})
    with pytest.raises(AssertionError, match="no plan scans"):
        assert_pruned_scan(plans, "orders", {"c_name"})
    with recorded_plans() as plans:
        df.agg(F.sum("c_acctbal")).collect()
    assert_no_single_partition(plans)


def test_bucket_lookup_is_map_side(spark):
    from varkit.plans.catalog import QUERIES
    plan = physical_plan(QUERIES["match_buckets"](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4 and set(df.columns) >= {"variable", "p50", "std"}
    assert set(E.oracle_sql()) <= set(E.queries())
