"""Figures built on the main queries: ratios, activity, segments, year-on-year, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import (
    first_match,
    mean,
    money,
    month_label,
    pct,
    share_true,
)
from stallworks.operators.grain import (
    DELIVERED,
    delivery,
    known_valid,
    label_lines,
    order_score,
    order_value,
    payment_by_order,
    person_months,
    person_orders,
    seller_order_value,
)
from stallworks.operators.ranking import with_running_sum
from stallworks.operators.shaping import share_of_total
from stallworks.operators.totals import monthly_sales, sales_totals, seller_totals
from stallworks.plans.customers import rfm_bands
from stallworks.sources.tables import Tables


def gmv_inflation(t: Tables, status: str = DELIVERED) -> DataFrame:
    """How far GMV over all statuses exceeds delivered GMV."""
    placed = t["orders"].select("order_id", "order_status").join(
        order_value(t["order_items"]).select("order_id", "gmv"), "order_id"
    )
    totals = placed.agg(
        F.sum("gmv").alias("all_gmv"),
        F.sum(F.when(F.col("order_status") == status, F.col("gmv"))).alias("delivered_gmv"),
    )
    everything, delivered = F.col("all_gmv"), F.col("delivered_gmv")
    return totals.select(
        money(everything).alias("all_gmv"),
        money(delivered).alias("delivered_gmv"),
        pct(everything - delivered, delivered).alias("inflation_pct"),
    )


def freight_ratio(t: Tables, status: str = DELIVERED) -> DataFrame:
    return sales_totals(t, status).select(
        money(F.col("gmv")).alias("gmv"),
        money(F.col("freight")).alias("freight"),
        pct(F.col("freight"), F.col("gmv")).alias("freight_pct"),
    )


def active_by_month(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Distinct buyers of each month."""
    return (
        person_months(t, status)
        .groupBy("month")
        .agg(F.count("*").alias("active_persons"))
        .orderBy("month")
        .select(month_label(F.col("month")).alias("ym"), "active_persons")
    )


def rfm_segments(t: Tables, top_pct: int = 30, status: str = DELIVERED) -> DataFrame:
    """The eight combinations of R, F and M bands, over all buyers."""
    segments = (
        rfm_bands(t, top_pct, status)
        .groupBy("r_band", "f_band", "m_band")
        .agg(F.count("*").alias("persons"), F.sum("m_gmv").alias("gmv"))
    )
    shared = share_of_total(share_of_total(segments, "persons", "persons_pct"), "gmv", "gmv_pct")
    return shared.orderBy("r_band", "f_band", "m_band").withColumn("gmv", money(F.col("gmv")))


def tier_by_cum_share(
    t: Tables, head_pct: int = 80, mid_pct: int = 95, status: str = DELIVERED
) -> DataFrame:
    """Seller tiers cut where cumulative GMV passes 80 and 95 percent.

    Sellers of equal GMV fold into one row first, so they always share a tier.
    """
    levels = (
        seller_totals(t, status)
        .filter(F.col("gmv").isNotNull())
        .groupBy("gmv")
        .agg(F.count("*").alias("sellers"))
        .withColumn("level_gmv", F.col("gmv") * F.col("sellers"))
    )
    summed = with_running_sum(levels, "level_gmv", F.desc("gmv"), name="running")
    total = summed.agg(F.sum("level_gmv")).scalar()
    label = first_match(
        [
            (F.col("running") * 100 <= total * head_pct, "head"),
            (F.col("running") * 100 <= total * mid_pct, "mid"),
        ],
        "tail",
    )
    tiers = (
        summed.withColumn("tier", label)
        .groupBy("tier")
        .agg(F.sum("sellers").alias("sellers"), F.sum("level_gmv").alias("gmv"))
    )
    return (
        share_of_total(tiers, "gmv", "gmv_pct")
        .orderBy("tier")
        .select("tier", "sellers", money(F.col("gmv")).alias("gmv"), "gmv_pct")
    )


def seller_health(t: Tables, bad: int = 2, status: str = DELIVERED) -> DataFrame:
    """Punctuality, delivery time and bad reviews of each seller side by side."""
    arrivals = delivery(t["orders"], status=status).select(
        "order_id", "delivery_days", "is_late"
    )
    score = F.col("score")
    return (
        seller_order_value(t, status)
        .join(arrivals, "order_id", "left")
        .join(order_score(t["order_reviews"]), "order_id", "left")
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("orders"),
            F.sum("gmv").alias("gmv"),
            share_true(~F.col("is_late")).alias("on_time_pct"),
            mean(F.col("delivery_days"), 1).alias("avg_days"),
            F.count(score).alias("scored_orders"),
            share_true(score <= bad).alias("bad_pct"),
        )
        .withColumn("gmv", money(F.col("gmv")))
    )


def category_new_buyers(t: Tables, status: str = DELIVERED) -> DataFrame:
    """People whose first valid order contained the category."""
    first_orders = (
        person_orders(t, status)
        .groupBy("person")
        .agg(F.min(F.struct("order_purchase_timestamp", "order_id")).alias("first"))
        .select(F.col("first.order_id").alias("order_id"))
    )
    # First orders are valid, so the pairs need no join with the valid orders.
    return (
        label_lines(t)(known_valid(t["order_items"], status))
        .join(first_orders, "order_id")
        .groupBy("category")
        .agg(F.count("*").alias("new_persons"))
        .orderBy(F.desc("new_persons"), "category")
    )


def monthly_yoy(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Growth over the same month a year earlier; NULL where that month had no sales."""
    months = monthly_sales(t, status).select("month", "gmv")
    year_before = months.select(
        F.add_months("month", 12).alias("month"), F.col("gmv").alias("before")
    )
    return (
        months.join(year_before, "month", "left")
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("ym"),
            money(F.col("gmv")).alias("gmv"),
            money(F.col("before")).alias("last_year_gmv"),
            pct(F.col("gmv") - F.col("before"), F.col("before")).alias("yoy_pct"),
        )
    )


def payments_per_order(t: Tables) -> DataFrame:
    """Payments summed to the order, the only grain at which they may meet other tables."""
    return payment_by_order(t["order_payments"]).withColumn("paid", money(F.col("paid")))
