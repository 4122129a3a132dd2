"""Logistics: delivery time, punctuality, and how both relate to scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import mean, pct, ratio, share_true
from stallworks.operators.grain import (
    DELIVERED,
    delivery,
    distinct_grain,
    known_valid,
    order_score,
)
from stallworks.operators.shaping import (
    band,
    by_band,
    histogram,
    mean_and_lower_median,
    share_of_total,
    top_k,
)
from stallworks.sources.tables import Tables

LATE_EDGES = (0, 3, 7)
LATE_LABELS = ("on_time", "late_1_3", "late_4_7", "late_over_7")
DAY_EDGES = (3, 7, 10, 15)
DAY_LABELS = ("<=3", "4-7", "8-10", "11-15", ">15")


def log_delivery_time(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Mean and lower median of delivery days; needs no estimate."""
    arrivals = delivery(t["orders"], need_estimate=False, status=status)
    return mean_and_lower_median(
        histogram(arrivals, "delivery_days"), "avg_days", "median_days", "delivered"
    )


def log_on_time_rate(t: Tables, sla_grain: str = "day", status: str = DELIVERED) -> DataFrame:
    late = F.col("is_late")
    return delivery(t["orders"], sla_grain, status=status).agg(
        F.count("*").alias("orders"),
        F.count_if(~late).alias("on_time"),
        F.count_if(late).alias("late"),
        share_true(late).alias("late_pct"),
        share_true(~late).alias("on_time_pct"),
    )


def log_late_bands(
    t: Tables,
    edges: Sequence[int] = LATE_EDGES,
    labels: Sequence[str] = LATE_LABELS,
    status: str = DELIVERED,
) -> DataFrame:
    banded = band(delivery(t["orders"], status=status), "late_days", edges, labels)
    return share_of_total(
        by_band(banded, F.count("*").alias("orders")), "orders", "pct"
    ).orderBy("band_order")


def state_deliveries(t: Tables, status: str = DELIVERED) -> DataFrame:
    """state -> orders, late orders, total delivery days."""
    per_customer = (
        delivery(t["orders"], status=status)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.count_if("is_late").alias("late"),
            F.sum("delivery_days").alias("days"),
            F.count("delivery_days").alias("dated"),
        )
    )
    return (
        per_customer.join(t["customers"].select("customer_id", "customer_state"), "customer_id")
        .groupBy(F.col("customer_state").alias("state"))
        .agg(*[F.sum(c).alias(c) for c in ("orders", "late", "days", "dated")])
    )


def log_state(t: Tables, min_orders: int = 200, k: int = 12, status: str = DELIVERED) -> DataFrame:
    rated = (
        state_deliveries(t, status)
        .filter(F.col("orders") >= min_orders)
        .select(
            "state",
            "orders",
            ratio(F.col("days"), F.col("dated"), 1).alias("avg_days"),
            pct(F.col("late"), F.col("orders")).alias("late_pct"),
        )
    )
    return top_k(rated, k, F.desc("late_pct"), F.col("state"))


def seller_deliveries(t: Tables, status: str = DELIVERED) -> DataFrame:
    """(seller, delivered order) with delivery_days and is_late, one row per pair."""
    pairs = distinct_grain(known_valid(t["order_items"], status), "seller_id", "order_id")
    arrivals = delivery(t["orders"], status=status).select("order_id", "delivery_days", "is_late")
    return pairs.join(arrivals, "order_id")


def log_seller(t: Tables, min_orders: int = 20, k: int = 12, status: str = DELIVERED) -> DataFrame:
    rated = (
        seller_deliveries(t, status)
        .groupBy("seller_id")
        .agg(
            F.count("*").alias("orders"),
            share_true(F.col("is_late")).alias("late_pct"),
            mean(F.col("delivery_days"), 1).alias("avg_days"),
        )
        .filter(F.col("orders") >= min_orders)
    )
    return top_k(rated, k, F.desc("late_pct"), F.col("seller_id"))


def scored_deliveries(t: Tables, sla_grain: str = "day", status: str = DELIVERED) -> DataFrame:
    """Delivered orders that have a review, with their score."""
    return delivery(t["orders"], sla_grain, status=status).join(
        order_score(t["order_reviews"]), "order_id"
    )


def log_days_band_vs_score(
    t: Tables,
    edges: Sequence[int] = DAY_EDGES,
    labels: Sequence[str] = DAY_LABELS,
    status: str = DELIVERED,
) -> DataFrame:
    banded = band(scored_deliveries(t, status=status), "delivery_days", edges, labels)
    return by_band(
        banded,
        F.count("*").alias("orders"),
        mean(F.col("score")).alias("avg_score"),
        F.count_if("is_late").alias("late"),
        share_true(F.col("is_late")).alias("late_pct"),
    ).orderBy("band_order")


def log_on_time_vs_score(t: Tables, sla_grain: str = "day", status: str = DELIVERED) -> DataFrame:
    return (
        scored_deliveries(t, sla_grain, status)
        .groupBy(F.when(F.col("is_late"), "late").otherwise("on_time").alias("fulfillment"))
        .agg(F.count("*").alias("orders"), mean(F.col("score")).alias("avg_score"))
    )
