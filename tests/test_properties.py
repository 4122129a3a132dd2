"""Invariants that hold on any data, checked on the derived marketplace tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stallworks.plans import business, customers, derived, logistics, products, quality, sellers
from stallworks.sources.roles import role_tables
from stallworks.sources.schemas import TABLE_NAMES
from stallworks.sources.tables import Tables
from tests.compare import spark_rows
from tests.shop import rows


@pytest.fixture(scope="module")
def t(spark, small_dir):
    return role_tables(spark, small_dir)


@pytest.mark.parametrize(
    "report, column",
    [
        (quality.dq_status_distribution, "pct"),
        (business.biz_monthly_trend, "gmv_pct"),
        (customers.cust_frequency, "pct"),
        (sellers.seller_tiers, "gmv_pct"),
        (sellers.seller_order_bands, "pct"),
        (logistics.log_late_bands, "pct"),
        (derived.rfm_segments, "persons_pct"),
    ],
)
def test_shares_add_up_to_one_hundred(t, report, column):
    shares = [r[column] for r in rows(report(t))]
    assert abs(sum(shares) - 100) <= 0.005 * len(shares) + 1e-9


def test_shares_are_taken_before_the_limit(t):
    few, all_states = (rows(business.biz_state_performance(t, k=k)) for k in (3, 100))
    assert few == all_states[:3]


def test_tiers_partition_the_sellers(t):
    sold = t["order_items"].join(t["orders"].filter("order_status = 'delivered'"), "order_id")
    total = sold.agg(F.count_distinct("seller_id").alias("n"), F.sum("price").alias("gmv"))
    expected = rows(total)[0]
    for report in (sellers.seller_tiers, derived.tier_by_cum_share):
        tiers = rows(report(t))
        assert sum(r["sellers"] for r in tiers) == expected["n"]
        assert round(sum(r["gmv"] for r in tiers), 2) == float(expected["gmv"])


def test_frequencies_weigh_up_to_the_valid_orders(t):
    weighed = sum(r["order_cnt"] * r["persons"] for r in rows(customers.cust_frequency(t)))
    assert weighed == t["orders"].filter("order_status = 'delivered'").count()


def test_punctual_and_late_make_all(t):
    r = rows(logistics.log_on_time_rate(t))[0]
    assert r["on_time"] + r["late"] == r["orders"]
    assert abs(r["on_time_pct"] + r["late_pct"] - 100) < 0.011
    bands = rows(logistics.log_late_bands(t))
    assert sum(b["orders"] for b in bands) == r["orders"]
    assert bands[0]["band"] == "on_time" and bands[0]["orders"] == r["on_time"]


def test_cohorts_start_complete(t):
    cohorts = rows(customers.cust_cohort_retention(t))
    first = [r for r in cohorts if r["period"] == 1]
    assert all(r["retention_pct"] == 100.0 for r in first)
    assert {r["first_ym"] for r in first} == {r["first_ym"] for r in cohorts}
    assert all(r["users"] <= r["cohort_size"] and r["period"] >= 1 for r in cohorts)
    new = {r["first_ym"]: r["new_persons"] for r in rows(customers.cust_new_by_month(t))}
    assert new == {r["first_ym"]: r["cohort_size"] for r in first}


def test_running_shares_end_at_one_hundred(t):
    shares = rows(products.prod_category_concentration(t, k=1000))
    assert shares[-1]["cum_pct"] == 100.0
    assert [r["cum_pct"] for r in shares] == sorted(r["cum_pct"] for r in shares)
    assert max(r["running_pct"] for r in rows(sellers.seller_ranking(t))) == 100.0


@pytest.mark.parametrize(
    "report",
    [
        business.biz_category_structure,
        customers.cust_rfm,
        customers.cust_repeat_gap,
        products.prod_top_per_category,
        sellers.seller_concentration,
        sellers.seller_tiers,
        sellers.seller_quality_risk,
        logistics.log_seller,
        derived.category_new_buyers,
    ],
)
def test_order_and_partitioning_do_not_matter(spark, t, report):
    mixed = Tables(**{name: t[name].orderBy(F.rand(7)).repartition(5) for name in TABLE_NAMES})
    expected = spark_rows(report(t))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert spark_rows(report(mixed)) == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")
