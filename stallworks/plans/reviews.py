"""Reviews: order-level scores by value band, payment type and category."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import mean, rounded, share_true
from stallworks.operators.grain import (
    DELIVERED,
    distinct_grain,
    label_orders,
    order_score,
    valid_order_value,
)
from stallworks.operators.shaping import band, by_band
from stallworks.sources.tables import Tables

VALUE_EDGES = (50, 100, 200, 400)
VALUE_LABELS = ("<50", "50-100", "100-200", "200-400", ">400")


def rev_order_score_summary(t: Tables, bad: int = 2, one_star: int = 1) -> DataFrame:
    """Scores over reviewed orders of every status; an order with only NULL scores is
    counted but enters no score figure."""
    score = F.col("score")
    return order_score(t["order_reviews"]).agg(
        F.count("*").alias("orders"),
        mean(score).alias("avg_score"),
        F.count_if(score <= bad).alias("bad_orders"),
        share_true(score <= bad).alias("bad_pct"),
        F.count_if(score <= one_star).alias("one_star_orders"),
    )


def rev_value_band_vs_score(
    t: Tables,
    edges: Sequence[int] = VALUE_EDGES,
    labels: Sequence[str] = VALUE_LABELS,
    status: str = DELIVERED,
) -> DataFrame:
    """Orders are banded by their whole value (in cents), not line by line."""
    scored = valid_order_value(t, status).join(order_score(t["order_reviews"]), "order_id")
    return by_band(
        band(scored, "gmv", [edge * 100 for edge in edges], labels, closed="left"),
        F.count("*").alias("orders"),
        mean(F.col("score")).alias("avg_score"),
    ).orderBy("band_order")


def rev_payment_vs_score(t: Tables, bad: int = 2) -> DataFrame:
    """Every (order, payment type) once, whatever the order status."""
    used = distinct_grain(
        t["order_payments"].filter(F.col("payment_type").isNotNull()), "order_id", "payment_type"
    )
    score = F.col("score")
    return (
        used.join(order_score(t["order_reviews"]), "order_id")
        .groupBy("payment_type")
        .agg(
            F.count("*").alias("orders"),
            mean(score).alias("avg_score"),
            share_true(score <= bad).alias("bad_pct"),
        )
        .orderBy(F.desc("orders"), "payment_type")
    )


def rev_category_score(t: Tables, min_orders: int = 100, status: str = DELIVERED) -> DataFrame:
    """Order scores averaged per category label, each order counted once."""
    return (
        label_orders(t, status)
        .join(order_score(t["order_reviews"]), "order_id")
        .groupBy("category")
        .agg(F.count("*").alias("reviewed_orders"), mean(F.col("score"), None).alias("exact"))
        .filter(F.col("reviewed_orders") >= min_orders)
        .orderBy(F.desc_nulls_last("exact"), "category")
        .select("category", "reviewed_orders", rounded(F.col("exact"), 2).alias("avg_score"))
    )
