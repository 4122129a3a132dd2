"""Metric definitions on hand-written shops: each one holds a trap of real order data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stallworks.operators import checks
from stallworks.operators.grain import delivery
from stallworks.operators.shaping import band, histogram, mean_and_lower_median
from stallworks.plans import (
    business,
    customers,
    derived,
    logistics,
    metrics,
    pages,
    products,
    profiling,
    quality,
    reviews,
    sellers,
)
from tests.shop import customer, item, order, payment, review, rows, shop


@pytest.fixture(scope="module")
def fan_out(spark):
    """One order with three items of two sellers, two payments and two reviews."""
    return shop(
        spark,
        orders=[order("o1", "2018-01-05 10:00")],
        customers=[customer("c-o1", "ann")],
        order_items=[
            item("o1", 1, "10.10", "s1"),
            item("o1", 2, "20.20", "s1"),
            item("o1", 3, "30.30", "s2"),
        ],
        order_payments=[payment("o1", 1, "card"), payment("o1", 2, "card")],
        order_reviews=[review("r1", "o1", 5), review("r2", "o1", 2)],
        products=[{"product_id": "p1", "product_category_name": "casa"}],
        sellers=[{"seller_id": "s1", "seller_state": "SP"}, {"seller_id": "s2", "seller_state": "RJ"}],
    )


def test_joins_do_not_multiply(fan_out):
    figures = rows(business.biz_core_kpis(fan_out))[0]
    assert (figures["gmv"], figures["valid_orders"], figures["aov"]) == (60.6, 1, 60.6)
    scored = {r["seller_id"]: r for r in rows(sellers.seller_quality_risk(fan_out, min_orders=1))}
    assert scored["s1"]["gmv"] == 30.3 and scored["s1"]["avg_score"] == 3.5
    assert scored["s1"]["reviewed_orders"] == scored["s2"]["reviewed_orders"] == 1
    assert rows(reviews.rev_payment_vs_score(fan_out))[0]["orders"] == 1


def test_payments_meet_orders_only_after_summing(fan_out):
    assert rows(derived.payments_per_order(fan_out)) == [
        {"order_id": "o1", "paid": 2.0, "records": 2, "payment_types": 1}
    ]


def test_people_are_not_customer_ids(spark):
    t = shop(
        spark,
        customers=[customer(f"c-o{i}", "ann") for i in (1, 2, 3)],
        orders=[
            order("o1", "2018-01-01 08:00"),
            order("o2", "2018-03-01 08:00"),
            order("o3", "2018-04-01 08:00", status="canceled"),
        ],
    )
    assert rows(customers.cust_id_vs_person(t)) == [
        {"customer_ids": 3, "persons": 1, "customer_rows": 3}
    ]
    assert rows(customers.cust_frequency(t)) == [{"order_cnt": 2, "persons": 1, "pct": 100.0}]
    assert rows(customers.cust_repeat_rate(t)) == [
        {"buyers": 1, "repeat_buyers": 1, "repeat_pct": 100.0}
    ]
    cohort = rows(customers.cust_cohort_retention(t))
    assert [(r["purchase_ym"], r["period"], r["users"]) for r in cohort] == [
        ("2018-01", 1, 1),
        ("2018-03", 3, 1),
    ]
    assert rows(customers.cust_repeat_gap(t)) == [{"avg_gap": 59.0, "median_gap": 59.0}]
    wide = rows(pages.cohort_matrix(t))[0]
    assert (wide["p01"], wide["p02"], wide["p03"]) == (100.0, None, 100.0)


def test_status_and_missing_dates(spark):
    t = shop(
        spark,
        orders=[
            order("a", "2018-01-01", arrived="2018-01-05", promised="2018-01-09"),
            order("b", "2018-01-01", arrived="2018-01-07", promised=None),
            order("c", "2018-01-01", arrived=None, promised="2018-01-09"),
            order("d", "2018-01-01", status="shipped", arrived="2018-01-30", promised="2018-01-09"),
            order("e", "2018-01-01", status="canceled"),
        ],
    )
    assert rows(logistics.log_delivery_time(t)) == [
        {"avg_days": 5.0, "median_days": 4.0, "delivered": 2}
    ]
    assert rows(logistics.log_on_time_rate(t)) == [
        {"orders": 1, "on_time": 1, "late": 0, "late_pct": 0.0, "on_time_pct": 100.0}
    ]


def test_lateness_is_decided_by_day(spark):
    promised = "2018-01-10 00:00"
    t = shop(
        spark,
        orders=[
            order("a", "2018-01-01", arrived="2018-01-09 23:59", promised=promised),
            order("b", "2018-01-01", arrived="2018-01-10 18:00", promised=promised),
            order("c", "2018-01-01", arrived="2018-01-11 00:00", promised=promised),
        ],
    )

    def late(grain):
        facts = delivery(t["orders"], grain).filter("is_late").orderBy("order_id")
        return [r["order_id"] for r in rows(facts)]

    assert late("day") == ["c"]
    assert late("timestamp") == ["b", "c"]
    with pytest.raises(ValueError):
        delivery(t["orders"], "hour")


def test_delivery_days_are_calendar_days(spark):
    t = shop(
        spark,
        orders=[order("a", "2018-01-01 23:50", arrived="2018-01-02 00:10", promised="2018-01-09")],
    )
    assert rows(delivery(t["orders"]))[0]["delivery_days"] == 1
    assert rows(delivery(t["orders"], "timestamp"))[0]["delivery_days"] == 0


def test_null_scores_count_orders_but_not_means(spark):
    t = shop(
        spark,
        order_reviews=[review("r1", "a", None), review("r2", "b", None), review("r3", "b", 4)],
    )
    assert rows(reviews.rev_order_score_summary(t)) == [
        {"orders": 2, "avg_score": 4.0, "bad_orders": 0, "bad_pct": 0.0, "one_star_orders": 0}
    ]


@pytest.fixture(scope="module")
def named(spark):
    """A NULL category, an untranslated one, and two raw names with one English name."""
    return shop(
        spark,
        orders=[order(f"o{i}", "2018-01-05") for i in range(1, 5)],
        customers=[customer(f"c-o{i}", f"p{i}") for i in range(1, 5)],
        order_items=[
            item("o1", 1, 5, product="x"),
            item("o2", 1, 6, product="y"),
            item("o3", 1, 7, product="a"),
            item("o4", 1, 8, product="b"),
            item("o4", 2, 1, product="a"),
        ],
        products=[
            {"product_id": "x", "product_category_name": None},
            {"product_id": "y", "product_category_name": "sem_traducao"},
            {"product_id": "a", "product_category_name": "casa"},
            {"product_id": "b", "product_category_name": "lar"},
        ],
        category_name=[
            {"product_category_name": "casa", "product_category_name_english": "home"},
            {"product_category_name": "lar", "product_category_name_english": "home"},
        ],
        order_reviews=[review(f"r{i}", f"o{i}", i) for i in range(1, 5)],
    )


def test_category_labels(named):
    structure = rows(business.biz_category_structure(named))
    assert [(r["category"], r["orders"]) for r in structure] == [
        ("home", 2),
        ("home", 1),
        ("sem_traducao", 1),
        ("unknown", 1),
    ]
    labels = [r["category"] for r in rows(products.prod_category_concentration(named))]
    assert None in labels and "unknown" not in labels
    by_label = {r["category"]: r for r in rows(reviews.rev_category_score(named, min_orders=1))}
    # o4 lies in two raw categories of one label: one order, not two.
    assert by_label["home"]["reviewed_orders"] == 2 and by_label["home"]["avg_score"] == 3.5


def test_item_weighted_and_order_weighted_scores_differ(spark):
    t = shop(
        spark,
        orders=[order("o1", "2018-01-05"), order("o2", "2018-01-05")],
        order_items=[item("o1", n, 1) for n in (1, 2, 3)] + [item("o2", 1, 1)],
        products=[{"product_id": "p1", "product_category_name": "casa"}],
        order_reviews=[review("r1", "o1", 1), review("r2", "o2", 5)],
    )
    by_item = rows(products.prod_category_score(t, min_orders=1))[0]
    by_order = rows(reviews.rev_category_score(t, min_orders=1))[0]
    assert (by_item["avg_score"], by_order["avg_score"]) == (2.0, 3.0)


def test_zero_price_gives_null_ratio(spark):
    t = shop(
        spark,
        orders=[order("o1", "2018-01-05")],
        order_items=[item("o1", 1, 0, freight=3)],
        products=[{"product_id": "p1", "product_category_name": "casa"}],
    )
    assert rows(products.prod_freight_sensitivity(t, min_orders=1)) == [
        {"category": "casa", "avg_price": 0.0, "avg_freight": 3.0, "freight_pct": None}
    ]


def _seller_shop(spark, amounts):
    return shop(
        spark,
        orders=[order(f"o{i}", "2018-01-05") for i in range(len(amounts))],
        order_items=[
            item(f"o{i}", 1, amount, seller=f"s{i:04d}") for i, amount in enumerate(amounts)
        ],
        products=[{"product_id": "p1", "product_category_name": "casa"}],
    )


def test_equal_sellers_share_the_running_value(spark):
    t = _seller_shop(spark, [10, 10, 10, 6, 4])
    top = rows(sellers.seller_concentration(t))
    assert [r["cum_pct"] for r in top] == [75.0, 75.0, 75.0, 90.0, 100.0]
    assert [r["seller_id"] for r in top[:3]] == ["s0000", "s0001", "s0002"]
    # A tie that the limit cuts through still counts in full.
    assert [r["cum_pct"] for r in rows(sellers.seller_concentration(t, k=2))] == [75.0, 75.0]


def test_category_ranks_with_ties(spark):
    t = shop(
        spark,
        orders=[order(f"o{i}", "2018-01-05") for i in range(5)],
        order_items=[
            item(f"o{i}", 1, price, product=f"p{i}")
            for i, price in enumerate([10, 10, 10, 6, 4])
        ],
        products=[{"product_id": f"p{i}", "product_category_name": f"k{i}"} for i in range(5)],
    )
    ranked = rows(products.prod_category_rank(t))
    assert [r["gmv_rank"] for r in ranked] == [1, 1, 1, 4, 5]
    assert [r["units_rank"] for r in ranked] == [1, 1, 1, 1, 1]


@pytest.mark.parametrize("count, head, mid", [(50, 1, 10), (51, 2, 11), (2970, 60, 594)])
def test_tier_sizes_round_up(spark, count, head, mid):
    t = _seller_shop(spark, [1 + i for i in range(count)])
    sizes = {r["tier"]: r["sellers"] for r in rows(sellers.seller_tiers(t))}
    assert sizes == {"head": head, "mid": mid - head, "tail": count - mid}


def test_rfm_bands_hold_exactly_the_top_share_despite_ties(spark):
    people = [f"p{i}" for i in range(10)]
    t = shop(
        spark,
        customers=[customer(f"c-o{i}", people[i % 10]) for i in range(11)],
        orders=[order(f"o{i}", f"2018-01-{1 + i:02d}") for i in range(11)],
        order_items=[item(f"o{i}", 1, 10) for i in range(11) if i != 4],
    )
    results = []
    for parts in ("3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append({r["person"]: r for r in rows(customers.cust_rfm(t))})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    bands = results[0]
    # p0 has two orders; the other places go to the first names among nine equals.
    assert sorted(p for p, r in bands.items() if r["f_band"] == "high") == ["p0", "p1", "p2"]
    assert sorted(p for p, r in bands.items() if r["r_band"] == "near") == ["p0", "p8", "p9"]
    assert bands["p4"]["m_gmv"] is None and bands["p4"]["m_band"] == "low"
    segments = rows(derived.rfm_segments(t))
    assert sum(r["persons"] for r in segments) == 10


@pytest.mark.parametrize(
    "values, median", [([4], 4), ([4, 8], 4), ([1, 2, 3, 9], 2), ([5, 1, 9, 7, 7], 7)]
)
def test_lower_median(spark, values, median):
    df = spark.createDataFrame([(v,) for v in values], "d int")
    assert rows(mean_and_lower_median(histogram(df, "d"), "m", "med", "n"))[0]["med"] == median


def test_same_day_orders_are_zero_gaps(spark):
    days = ["2018-01-01 08:00", "2018-01-01 09:00", "2018-01-01 23:00", "2018-01-04 01:00"]
    t = shop(
        spark,
        customers=[customer(f"c-o{i}", "ann") for i in range(4)],
        orders=[order(f"o{i}", d) for i, d in enumerate(days)],
    )
    assert rows(customers.cust_repeat_gap(t)) == [{"avg_gap": 1.0, "median_gap": 0.0}]


def test_growth_over_missing_months(spark):
    months = ["2017-01", "2017-02", "2017-04", "2018-02", "2018-03"]
    t = shop(
        spark,
        orders=[order(f"o{i}", f"{m}-10") for i, m in enumerate(months)],
        order_items=[item(f"o{i}", 1, 100 * (i + 1)) for i in range(5)],
    )
    mom = {r["ym"]: r for r in rows(business.biz_monthly_mom(t))}
    assert mom["2017-01"]["mom_pct"] is None
    assert mom["2017-04"]["prev_gmv"] == 200.0 and mom["2017-04"]["mom_pct"] == 50.0
    yoy = {r["ym"]: r["yoy_pct"] for r in rows(derived.monthly_yoy(t))}
    assert yoy["2018-02"] == 100.0 and yoy["2018-03"] is None


def test_bands_close_on_either_side(spark):
    df = spark.createDataFrame([(v,) for v in (3, 4, 50, None)], "v int")

    def labels(closed):
        return [r["band"] for r in rows(band(df, "v", (3, 50), ("a", "b", "c"), closed))]

    assert labels("right") == ["a", "b", "b", "c"]
    assert labels("left") == ["b", "b", "c", "c"]
    with pytest.raises(ValueError):
        band(df, "v", (1, 2), ("a", "b"))


def test_empty_shop_gives_zeros_and_nulls(spark):
    t = shop(spark)
    assert rows(business.biz_core_kpis(t)) == [
        {
            "gmv": None, "freight": None, "valid_orders": 0, "aov": None,
            "persons": 0, "sellers": 0, "products": 0,
        }
    ]
    assert rows(customers.cust_repeat_rate(t)) == [
        {"buyers": 0, "repeat_buyers": 0, "repeat_pct": None}
    ]
    assert rows(logistics.log_delivery_time(t)) == [
        {"avg_days": None, "median_days": None, "delivered": 0}
    ]
    assert rows(customers.cust_rfm(t)) == [] and rows(sellers.seller_tiers(t)) == []
    assert rows(sellers.seller_concentration(t)) == []
    assert rows(quality.dq_orphan_orders(t)) == [{"orphan_orders": 0}]
    assert rows(pages.cohort_matrix(t)) == []
    assert all(r["rows_cnt"] == 0 for r in rows(quality.dq_row_counts(t)))


def test_checks_report_every_broken_rule(spark):
    t = shop(
        spark,
        customers=[customer("c1", None)],
        orders=[order("o1", "2018-01-01", customer="c1"), order("o2", None, customer="nobody")],
        order_items=[
            item("o1", 1, -5), item("o1", 1, 5), item("ghost", 1, 1), item("o1", 2, 3, seller=None),
        ],
        products=[{"product_id": "p1"}],
        sellers=[{"seller_id": "s1"}],
        order_reviews=[review("r1", "o1", 6)],
        order_payments=[payment("o1", 1, "card", -1)],
    )
    keys = {r["tbl"]: (r["repeated_keys"], r["surplus_rows"]) for r in rows(checks.primary_key_check(t))}
    assert keys["order_items"] == (1, 1) and keys["orders"] == (0, 0)
    refs = {r["reference"]: r["orphan_rows"] for r in rows(checks.foreign_key_check(t))}
    assert refs["orders.customer_id"] == 1 and refs["order_items.order_id"] == 1
    assert refs["order_items.seller_id"] == 0  # a NULL reference is no orphan
    nulls = {(r["tbl"], r["rule"]): r["null_rows"] for r in rows(checks.not_null_check(t))}
    assert nulls["customers", "customer_unique_id"] == 1 and nulls["orders", "order_id"] == 0
    bad = {r["rule"]: r["bad_rows"] for r in rows(checks.domain_check(t))}
    assert bad == {
        "price < 0": 1, "freight_value < 0": 0, "payment_value < 0": 1,
        "review_score out of range": 1,
    }
    assert rows(quality.dq_orphan_orders(t)) == [{"orphan_orders": 1}]


def test_measures_agree_with_reports(spark, named):
    total = rows(metrics.metric_table(named, ["gmv", "valid_orders", "buyers", "aov"]))[0]
    report = rows(business.biz_core_kpis(named))[0]
    assert total["gmv"] == report["gmv"] and total["valid_orders"] == report["valid_orders"]
    only = metrics.metric_table(
        named, ["gmv", "buyers"], filters={"category": F.col("category") == "home"}
    )
    assert rows(only) == [{"gmv": 16.0, "buyers": 2}]
    with pytest.raises(ValueError):
        metrics.metric_table(named, ["profit"])
    with pytest.raises(ValueError):
        metrics.metric_table(named, ["gmv"], dims=["colour"])


def test_repeat_check_agrees_with_repeat_rate(named):
    assert rows(profiling.repeat_check(named)) == rows(customers.cust_repeat_rate(named))
