"""Exploratory profile: sizes, uniqueness, multiplicities and cross-checks of headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import mean, money, money_ratio, pct, rounded
from stallworks.operators.checks import stacked
from stallworks.operators.cleaning import duplicate_reviews
from stallworks.operators.grain import DELIVERED, valid_orders
from stallworks.operators.totals import sales_totals
from stallworks.plans.logistics import scored_deliveries
from stallworks.plans.quality import ORDER_TIMES
from stallworks.sources.tables import Tables


def table_profile(t: Tables, shown: int = 6) -> DataFrame:
    """Rows and leading column names of every table."""
    return stacked(
        [
            t[name]
            .agg(F.count("*").alias("rows_cnt"))
            .select(
                F.lit(name).alias("tbl"),
                "rows_cnt",
                F.lit(",".join(t[name].columns[:shown])).alias("first_columns"),
            )
            for name in t.present()
        ]
    )


def order_profile(t: Tables) -> DataFrame:
    """Rows, distinct ids and NULL times of the orders."""
    per_id = t["orders"].groupBy("order_id").agg(
        F.count("*").alias("n"),
        *[
            F.count_if(F.col(ORDER_TIMES[name]).isNull()).alias(name)
            for name in ("approved", "carrier", "delivered", "estimated")
        ],
    )
    return per_id.agg(
        F.sum("n").alias("order_rows"),
        F.count("order_id").alias("order_ids"),
        *[
            F.sum(name).alias(f"{name}_nulls")
            for name in ("approved", "carrier", "delivered", "estimated")
        ],
    )


def status_counts(t: Tables) -> DataFrame:
    return (
        t["orders"]
        .groupBy("order_status")
        .agg(F.count("*").alias("order_cnt"))
        .orderBy(F.desc("order_cnt"), "order_status")
    )


def review_duplicates(raw_reviews: DataFrame) -> DataFrame:
    return duplicate_reviews(raw_reviews)


def multi_review_orders(t: Tables) -> DataFrame:
    per_order = t["order_reviews"].groupBy("order_id").agg(F.count("*").alias("n"))
    return per_order.agg(
        F.count("*").alias("reviewed_orders"), F.count_if(F.col("n") > 1).alias("multi_review_orders")
    )


def payment_split(t: Tables) -> DataFrame:
    """Orders paid by one record and by several."""
    per_order = t["order_payments"].groupBy("order_id").agg(F.count("*").alias("n"))
    return per_order.agg(
        F.count_if(F.col("n") == 1).alias("single_payment_orders"),
        F.count_if(F.col("n") > 1).alias("multi_payment_orders"),
    )


def sales_check(t: Tables, status: str = DELIVERED) -> DataFrame:
    return sales_totals(t, status).select(
        F.col("orders").alias("valid_orders"),
        money(F.col("gmv")).alias("gmv"),
        money_ratio(F.col("gmv"), F.col("orders")).alias("aov"),
        money(F.col("freight")).alias("freight"),
    )


def repeat_check(t: Tables, min_ids: int = 2, status: str = DELIVERED) -> DataFrame:
    """Repeat buyers by distinct customer ids instead of orders: both must agree, as every
    order has its own customer id."""
    ids = valid_orders(t["orders"], status).select("customer_id").distinct()
    per_person = (
        t["customers"]
        .select("customer_id", "customer_unique_id")
        .join(ids, "customer_id", "left_semi")
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("n"))
    )
    return per_person.agg(
        F.count("*").alias("buyers"), F.count_if(F.col("n") >= min_ids).alias("repeat_buyers")
    ).withColumn("repeat_pct", pct(F.col("repeat_buyers"), F.col("buyers")))


def late_score_check(t: Tables, sla_grain: str = "timestamp", status: str = DELIVERED) -> DataFrame:
    """Mean score of punctual and late orders by instant comparison, and the difference."""
    score, late = F.col("score"), F.col("is_late")
    means = scored_deliveries(t, sla_grain, status).agg(
        mean(F.when(~late, score), None).alias("on_time"),
        mean(F.when(late, score), None).alias("late"),
    )
    return means.select(
        rounded(F.col("on_time"), 2).alias("on_time_score"),
        rounded(F.col("late"), 2).alias("late_score"),
        rounded(F.col("on_time") - F.col("late"), 2).alias("score_drop"),
    )
