"""Global ranks and running sums equal the plain one-partition window on every row."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from stallworks.operators.ranking import shared_folder, tier, with_rank, with_running_sum


def _check(df):
    order = [F.desc_nulls_last("v"), F.asc("id")]
    w = Window.orderBy(*order)
    ranked = with_rank(df.withColumn("plain", F.row_number().over(w)), *order)
    assert ranked.count() == df.count()
    assert ranked.filter(F.col("rn") != F.col("plain")).count() == 0
    running = F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    summed = with_running_sum(
        df.filter("v IS NOT NULL").withColumn("plain", running), "v", *order, name="total"
    )
    assert summed.filter(F.col("total") != F.col("plain")).count() == 0


@pytest.mark.parametrize("value", ["id * 7919 % 10007", "cast(id % 100 = 0 AS int)", "1", "-id"])
@pytest.mark.parametrize("parts", ["1", "5", "8"])
def test_equals_plain_window(spark, value, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    _check(spark.range(0, 3000, 1, 4).selectExpr("id", f"cast({value} AS bigint) AS v"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=0, max_size=40))
def test_any_values(spark, values):
    data = [(i, v) for i, v in enumerate(values)]
    _check(spark.createDataFrame(data, "id bigint, v bigint"))


def test_heavy_ties_spread_over_slices(spark):
    from stallworks.operators.ranking import sliced

    df = spark.range(0, 20000, 1, 4).selectExpr("id", "1 AS v")
    sizes = [r["count"] for r in sliced(df, F.desc("v"), F.asc("id")).groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20000 / 8


def test_tier_cuts_are_exact(spark):
    for total in (1, 49, 50, 51, 99, 2970):
        df = spark.range(1, total + 1).select(
            tier(F.col("id"), F.lit(total), {"head": 2, "mid": 20}, "tail").alias("tier"), "id"
        )
        heads = df.filter("tier = 'head'").count()
        mids = df.filter("tier IN ('head', 'mid')").count()
        assert heads == -(-total * 2 // 100) and mids == -(-total * 20 // 100)


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    else:
        assert "stallworks-" in shared_folder(spark)
