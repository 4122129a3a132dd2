"""Wall-clock times mean the same in every session time zone, daylight saving included."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from stallworks.functions.expressions import elapsed_days
from tests.compare import connect, difference
from tests.shop import rows

NAMES = (
    "biz_monthly_trend",
    "clean_orders",
    "cust_cohort_retention",
    "cust_repeat_gap",
    "cust_rfm",
    "grain_delivery",
    "log_late_bands",
    "log_on_time_vs_score_timestamp",
    "csv_monthly_trend",
)


@pytest.fixture(params=["America/Sao_Paulo", "Asia/Tokyo"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("name", NAMES)
def test_results_do_not_move(spark, zone, small_dir, name):
    con, sql = connect(small_dir), contract.oracle_sql()[name]
    assert difference(contract.queries()[name](spark, small_dir), con, sql) is None


@pytest.mark.parametrize(
    "start, end, days",
    [
        # Clocks in Sao Paulo went from 00:00 to 01:00 on 2017-10-15.
        ("2017-10-14 12:00:00", "2017-10-15 11:59:59", 0),
        ("2017-10-14 12:00:00", "2017-10-15 12:00:00", 1),
        ("2017-10-14 00:30:00", "2017-10-15 00:30:00", 1),
        ("2018-01-02 12:00:00", "2018-01-02 10:00:00", -1),
        ("2018-01-02 12:00:00", "2018-01-01 12:00:00", -1),
        ("2018-01-02 12:00:00", "2018-01-01 11:00:00", -2),
    ],
)
def test_elapsed_days(spark, zone, start, end, days):
    df = spark.sql(f"SELECT timestamp_ntz'{start}' AS a, timestamp_ntz'{end}' AS b")
    assert rows(df.select(elapsed_days(df.a, df.b).alias("d"))) == [{"d": days}]
