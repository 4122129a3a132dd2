"""Business overview: headline figures, growth, regions and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.functions.expressions import money, money_ratio, month_label, pct
from stallworks.operators.grain import (
    DELIVERED,
    order_value,
    valid_order_value,
    with_labels,
)
from stallworks.operators.shaping import share_of_total, top_k
from stallworks.operators.totals import category_totals, monthly_sales, sales_totals
from stallworks.sources.tables import Tables


def biz_core_kpis(t: Tables, status: str = DELIVERED) -> DataFrame:
    def whole(table: str, key: str):
        return t[table].agg(F.count_distinct(key)).scalar()

    return sales_totals(t, status).select(
        money(F.col("gmv")).alias("gmv"),
        money(F.col("freight")).alias("freight"),
        F.col("orders").alias("valid_orders"),
        money_ratio(F.col("gmv"), F.col("orders")).alias("aov"),
        whole("customers", "customer_unique_id").alias("persons"),
        whole("sellers", "seller_id").alias("sellers"),
        whole("products", "product_id").alias("products"),
    )


def biz_all_vs_delivered(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Every status against delivered only, in one scan."""
    placed = t["orders"].select("order_id", "order_status").join(
        order_value(t["order_items"]), "order_id"
    )
    totals = placed.agg(
        F.count("*").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.sum(F.when(F.col("order_status") == status, F.col("gmv"))).alias("delivered"),
    )
    return totals.select(
        F.col("orders").alias("all_orders"),
        money(F.col("gmv")).alias("all_gmv"),
        money_ratio(F.col("gmv"), F.col("orders")).alias("all_aov"),
        money(F.col("delivered")).alias("delivered_gmv"),
    )


def biz_monthly_trend(t: Tables, status: str = DELIVERED) -> DataFrame:
    return trend_report(monthly_sales(t, status))


def trend_report(months: DataFrame) -> DataFrame:
    return (
        share_of_total(months, "gmv", "gmv_pct")
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("ym"),
            "orders",
            money(F.col("gmv")).alias("gmv"),
            money_ratio(F.col("gmv"), F.col("orders")).alias("aov"),
            "gmv_pct",
        )
    )


def biz_monthly_mom(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Growth over the previous month that has sales."""
    before = F.lag("gmv").over(Window.orderBy("month"))
    return (
        monthly_sales(t, status)
        .withColumn("before", before)
        .orderBy("month")
        .select(
            month_label(F.col("month")).alias("ym"),
            money(F.col("gmv")).alias("gmv"),
            money(F.col("before")).alias("prev_gmv"),
            pct(F.col("gmv") - F.col("before"), F.col("before")).alias("mom_pct"),
        )
    )


def biz_state_performance(t: Tables, k: int = 15, status: str = DELIVERED) -> DataFrame:
    """Sales by customer state; persons are counted by grouping twice, not by COUNT DISTINCT."""
    per_customer = (
        valid_order_value(t, status)
        .groupBy("customer_id")
        .agg(F.count("*").alias("orders"), F.sum("gmv").alias("gmv"))
    )
    per_person = (
        per_customer.join(
            t["customers"].select("customer_id", "customer_unique_id", "customer_state"),
            "customer_id",
        )
        .groupBy("customer_state", "customer_unique_id")
        .agg(F.sum("orders").alias("orders"), F.sum("gmv").alias("gmv"))
    )
    per_state = per_person.groupBy(F.col("customer_state").alias("state")).agg(
        F.sum("orders").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.count("customer_unique_id").alias("persons"),
    )
    shared = share_of_total(per_state, "gmv", "gmv_pct")
    return top_k(shared, k, F.desc("gmv"), F.col("state")).select(
        "state",
        "orders",
        money(F.col("gmv")).alias("gmv"),
        money_ratio(F.col("gmv"), F.col("orders")).alias("aov"),
        "persons",
        "gmv_pct",
    )


def biz_category_structure(t: Tables, k: int = 20, status: str = DELIVERED) -> DataFrame:
    """Orders and GMV per raw category; raw names that share an English name stay apart."""
    return top_k(
        with_labels(category_totals(t, status), t), k, F.desc("gmv"), F.col("category"), F.col("raw_category")
    ).select("category", "orders", money(F.col("gmv")).alias("gmv"))
