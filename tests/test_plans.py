"""What the physical plans may and may not hold, checked on every registered query."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as contract
from stallworks.plans.business import biz_monthly_trend
from stallworks.plans.products import prod_top_per_category
from stallworks.registry import registered_queries
from stallworks.sources.roles import role_tables
from tests.compare import connect, difference

QUERIES = registered_queries()
SOURCES = r"Aggregate|Limit|TakeOrdered|Exchange hash|Scan"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_cross_joins_or_global_windows_over_rows(spark, small_dir, name):
    plan = physical(QUERIES[name](spark, small_dir))
    for banned in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"):
        assert banned not in plan, banned
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        # Only aggregates or top-k rows may meet in one task, never scanned rows.
        source = next(x for x in lines[i + 1 :] if re.search(SOURCES, x))
        assert re.search("Aggregate|Limit|TakeOrdered", source), source


def test_scans_read_only_needed_columns_and_push_filters(spark, small_dir):
    plan = physical(biz_monthly_trend(role_tables(spark, small_dir)))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "l_orderkey:bigint,l_linenumber:int,l_extendedprice:double" in schemas
    assert all("o_custkey" not in s for s in schemas)


def test_top_products_are_cut_before_the_shuffle(spark, small_dir):
    plan = physical(prod_top_per_category(role_tables(spark, small_dir)))
    assert plan.count("WindowGroupLimit") == 2


def test_repeated_reviews_are_cut_before_the_shuffle(spark, small_dir):
    plan = physical(QUERIES["clean_order_reviews"](spark, small_dir))
    assert plan.count("WindowGroupLimit") == 2


def test_items_are_reduced_before_they_are_shuffled(spark, small_dir):
    """Each exchange of line items sits on a partial aggregate, so that a hot key
    leaves every task as one row."""
    for name in ("biz_monthly_trend", "biz_category_structure", "seller_tiers", "log_seller"):
        lines = physical(QUERIES[name](spark, small_dir)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line and "order_id" in line:
                assert "HashAggregate" in lines[i + 1], (name, lines[i + 1])


def _run(df) -> str:
    """The final plan after a run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return physical(df)


@pytest.fixture
def large_tables(spark):
    """Thresholds scaled down so that test data counts as large: nothing is broadcast by
    size, and partitions of some kilobytes may be skewed."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4KB",
        "spark.sql.shuffle.partitions": "16",
        # Several map tasks, as Spark splits a hot partition between the maps that fed it.
        "spark.sql.files.maxPartitionBytes": "64KB",
        "spark.sql.files.openCostInBytes": "1KB",
    }
    before = {key: spark.conf.get(key) for key in small}
    for key, value in small.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_hot_product_is_split_when_products_are_too_large_to_broadcast(spark, hot_dir, large_tables):
    plan = _run(QUERIES["biz_category_structure"](spark, hot_dir))
    assert "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize(
    "name",
    [
        "biz_category_structure", "biz_state_performance", "cust_cohort_retention", "cust_rfm",
        "cust_repeat_gap", "prod_category_score", "rev_category_score", "seller_concentration",
        "seller_quality_risk", "seller_tiers", "log_seller", "metric_sales_by_category",
        "rev_payment_vs_score", "category_new_buyers", "check_foreign_keys",
    ],
)
def test_results_hold_without_size_based_broadcasts(spark, hot_dir, large_tables, name):
    con, sql = connect(hot_dir), contract.oracle_sql()[name]
    assert difference(QUERIES[name](spark, hot_dir), con, sql) is None
