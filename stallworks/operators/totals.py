"""Additive totals by month, seller, category and product.

Every order belongs to one month and counts once per seller, category and product in it,
so counts of distinct orders add up over months. Where the stored monthly layers are
attached to the tables, the totals are sums over those small tables; otherwise they
come from the item lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import month_start
from stallworks.operators.grain import (
    DELIVERED,
    category_order_value,
    product_order_value,
    seller_order_value,
    valid_order_value,
    valid_orders,
)
from stallworks.sources.schemas import MONTH
from stallworks.sources.tables import Tables

CATEGORY_MEASURES = ("gmv", "freight", "units", "priced", "freighted")


def _summed(df: DataFrame, key: str, *measures: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(m).alias(m) for m in measures])


def _stored_sales(t: Tables, status: str) -> DataFrame | None:
    """Months of the stored summary in which valid orders with items were placed."""
    summary = t.layer("month_summary")
    if summary is None:
        return None
    return valid_orders(summary, status).filter(F.col("orders") > 0)


def sales_totals(t: Tables, status: str = DELIVERED) -> DataFrame:
    """One row of totals, in cents, over valid orders with items."""
    stored = _stored_sales(t, status)
    amounts = [F.sum("gmv").alias("gmv"), F.sum("freight").alias("freight")]
    if stored is not None:
        orders = F.coalesce(F.sum("orders"), F.lit(0))
        return stored.agg(*amounts, orders.cast("bigint").alias("orders"))
    return valid_order_value(t, status).agg(*amounts, F.count("*").alias("orders"))


def monthly_sales(t: Tables, status: str = DELIVERED) -> DataFrame:
    """month -> orders, gmv in cents (a bounded table: one row per month)."""
    stored = _stored_sales(t, status)
    if stored is not None:
        months = stored.withColumn("month", F.to_date(F.col(MONTH), "yyyy-MM"))
        return _summed(months, "month", "orders", "gmv")
    return (
        valid_order_value(t, status)
        .groupBy(month_start(F.col("order_purchase_timestamp")).alias("month"))
        .agg(F.count("*").alias("orders"), F.sum("gmv").alias("gmv"))
    )


def seller_totals(t: Tables, status: str = DELIVERED) -> DataFrame:
    """seller -> gmv in cents, distinct valid orders."""
    stored = t.layer("seller_months")
    if stored is not None:
        return _summed(valid_orders(stored, status), "seller_id", "gmv", "orders")
    return (
        seller_order_value(t, status)
        .groupBy("seller_id")
        .agg(F.sum("gmv").alias("gmv"), F.count("*").alias("orders"))
    )


def category_totals(t: Tables, status: str = DELIVERED) -> DataFrame:
    """raw category -> orders, gmv, freight, units and value counts (a bounded table)."""
    stored = t.layer("category_months")
    if stored is not None:
        return _summed(valid_orders(stored, status), "raw_category", "orders", *CATEGORY_MEASURES)
    return (
        category_order_value(t, status)
        .groupBy("raw_category")
        .agg(F.count("*").alias("orders"), *[F.sum(m).alias(m) for m in CATEGORY_MEASURES])
    )


def product_totals(t: Tables, status: str = DELIVERED) -> DataFrame:
    """product -> distinct valid orders, gmv in cents."""
    stored = t.layer("product_months")
    if stored is not None:
        return _summed(valid_orders(stored, status), "product_id", "orders", "gmv")
    return (
        product_order_value(t, status)
        .groupBy("product_id")
        .agg(F.count("*").alias("orders"), F.sum("gmv").alias("gmv"))
    )
