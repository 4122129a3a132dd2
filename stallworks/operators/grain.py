"""Grain tables: each reduces a one-to-many side before it is joined.

Joining items to payments or reviews row by row would multiply amounts, so every
query starts from one of these. Each one groups before it joins: Spark then combines
on the map side, and an order, seller or product that owns a large part of all rows
leaves each task as a single row instead of travelling to one reducer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import calendar_days, cents, elapsed_days, month_start
from stallworks.sources.schemas import MONTH
from stallworks.sources.tables import Tables

DELIVERED = "delivered"
UNKNOWN_CATEGORY = "unknown"

# One order's mean score keeps four decimals, and exact decimals add up the same
# in whatever order partitions arrive.
SCORE_TYPE = "decimal(14,4)"


def valid_orders(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.filter(F.col("order_status") == status)


def order_value(items: DataFrame) -> DataFrame:
    """order_id -> gmv and freight in cents, units."""
    return items.groupBy("order_id").agg(
        F.sum(cents(F.col("price"))).alias("gmv"),
        F.sum(cents(F.col("freight_value"))).alias("freight"),
        F.count("*").alias("units"),
    )


def known_valid(items: DataFrame, status: str = DELIVERED) -> DataFrame:
    """Items without those of which the stored status already says that they are not valid.

    Raw items do not know their order's status and stay all.
    """
    return valid_orders(items, status) if "order_status" in items.columns else items


def valid_order_value(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Valid orders that have items, one row each, with their amounts."""
    placed = valid_orders(t["orders"], status).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )
    return placed.join(order_value(known_valid(t["order_items"], status)), "order_id")


def order_score(reviews: DataFrame) -> DataFrame:
    """order_id -> mean review score (NULL if every score is NULL)."""
    return reviews.groupBy("order_id").agg(
        F.avg("review_score").cast(SCORE_TYPE).alias("score")
    )


def distinct_grain(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key combination."""
    return df.select(*keys).distinct()


def of_valid_orders(lines: DataFrame, t: Tables, status: str = DELIVERED) -> DataFrame:
    return lines.join(valid_orders(t["orders"], status).select("order_id"), "order_id")


def valid_lines(
    t: Tables, reduce: Callable[[DataFrame], DataFrame], status: str = DELIVERED
) -> DataFrame:
    """Items of valid orders, reduced to (some key, order).

    Stored items carry the status of their order and are filtered in the scan. Raw items
    are reduced first and then joined with the valid orders.
    """
    items = t["order_items"]
    if "order_status" in items.columns:
        return reduce(valid_orders(items, status))
    return of_valid_orders(reduce(items), t, status)


def _lines(items: DataFrame, together: bool) -> DataFrame:
    """The items; with ``together`` sent to their order at once, so that lines reduced by order join
    their order without a second exchange."""
    return items.repartition("order_id") if together else items


def seller_lines(items: DataFrame, together: bool = False) -> DataFrame:
    """(seller, order) -> gmv in cents, units."""
    return _lines(items, together).groupBy("seller_id", "order_id").agg(
        F.sum(cents(F.col("price"))).alias("gmv"), F.count("*").alias("units")
    )


def product_lines(items: DataFrame, together: bool = False) -> DataFrame:
    """(product, order) -> gmv in cents."""
    return _lines(items, together).groupBy("product_id", "order_id").agg(
        F.sum(cents(F.col("price"))).alias("gmv")
    )


def seller_order_value(t: Tables, status: str = DELIVERED) -> DataFrame:
    """(seller, valid order) -> gmv in cents, units."""
    return valid_lines(t, seller_lines, status)


def product_order_value(t: Tables, status: str = DELIVERED) -> DataFrame:
    """(product, valid order) -> gmv in cents."""
    return valid_lines(t, product_lines, status)


def product_category(t: Tables, fallback: str | None = UNKNOWN_CATEGORY) -> DataFrame:
    """product -> raw category, English name, and the label shown in reports."""
    translated = t["products"].select("product_id", "product_category_name").join(
        t["category_name"], "product_category_name", "left"
    )
    return translated.select(
        "product_id",
        F.col("product_category_name").alias("raw_category"),
        F.col("product_category_name_english").alias("english_category"),
        category_label("product_category_name_english", "product_category_name", fallback),
    )


def category_label(english: str, raw: str, fallback: str | None):
    names = [F.col(english), F.col(raw)]
    if fallback is not None:
        names.append(F.lit(fallback))
    return F.coalesce(*names).alias("category")


def category_lines(items: DataFrame, products: DataFrame, together: bool = False) -> DataFrame:
    """(raw category, order) -> gmv and freight in cents, units, and the counts behind
    averages.

    The raw name decides the English one, so translation waits until the categories
    are aggregated (see ``with_labels``).
    """
    categories = products.select(
        "product_id", F.col("product_category_name").alias("raw_category")
    )
    return (
        _lines(items.join(categories, "product_id"), together)
        .groupBy("raw_category", "order_id")
        .agg(
            F.sum(cents(F.col("price"))).alias("gmv"),
            F.sum(cents(F.col("freight_value"))).alias("freight"),
            F.count("*").alias("units"),
            F.count("price").alias("priced"),
            F.count("freight_value").alias("freighted"),
        )
    )


def category_order_value(t: Tables, status: str = DELIVERED) -> DataFrame:
    """``category_lines`` of valid orders."""
    return valid_lines(t, lambda items: category_lines(items, t["products"]), status)


def with_labels(
    per_category: DataFrame, t: Tables, fallback: str | None = UNKNOWN_CATEGORY
) -> DataFrame:
    """Attach the report label to rows keyed by raw category."""
    names = t["category_name"].select(
        F.col("product_category_name").alias("raw_category"),
        F.col("product_category_name_english").alias("english_category"),
    )
    return per_category.join(names, "raw_category", "left").withColumn(
        "category", category_label("english_category", "raw_category", fallback)
    )


def label_lines(t: Tables) -> Callable[[DataFrame], DataFrame]:
    """From items to distinct (category label, order): two raw names may share a label."""
    labels = product_category(t).select("product_id", "category")

    def pairs(items: DataFrame) -> DataFrame:
        labelled = items.select("order_id", "product_id").join(labels, "product_id")
        return distinct_grain(labelled, "category", "order_id")

    return pairs


def label_orders(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Distinct (category label, valid order)."""
    return valid_lines(t, label_lines(t), status)


def person_orders(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Valid orders with the person behind them."""
    placed = valid_orders(t["orders"], status).select(
        "order_id", "customer_id", "order_purchase_timestamp"
    )
    people = t["customers"].select("customer_id", F.col("customer_unique_id").alias("person"))
    return placed.join(people, "customer_id").select(
        "person", "order_id", "order_purchase_timestamp"
    )


def person_totals(t: Tables, status: str = DELIVERED) -> DataFrame:
    """person -> valid orders, first and last purchase.

    Orders are first reduced per customer id, on the partitioning the join needs anyway.
    """
    per_customer = (
        valid_orders(t["orders"], status)
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders"),
            F.min("order_purchase_timestamp").alias("first_purchase"),
            F.max("order_purchase_timestamp").alias("last_purchase"),
        )
    )
    people = t["customers"].select("customer_id", F.col("customer_unique_id").alias("person"))
    return (
        per_customer.join(people, "customer_id")
        .groupBy("person")
        .agg(
            F.sum("orders").alias("orders"),
            F.min("first_purchase").alias("first_purchase"),
            F.max("last_purchase").alias("last_purchase"),
        )
    )


def _stored_activity(stored: DataFrame, status: str) -> DataFrame:
    """(person, month, orders); the month is a date, NULL where no purchase time is known."""
    return valid_orders(stored, status).select(
        "person", F.to_date(F.col(MONTH), "yyyy-MM").alias("month"), "orders"
    )


def person_activity(t: Tables, status: str = DELIVERED) -> DataFrame:
    """person -> valid orders and first purchase month; from stored person months where attached.

    A person's months are distinct rows of a month each, so counts add up and the first
    month is the least one; no order is read.
    """
    stored = t.layer("person_months")
    if stored is not None:
        return (
            _stored_activity(stored, status)
            .groupBy("person")
            .agg(F.sum("orders").alias("orders"), F.min("month").alias("first_month"))
        )
    return person_totals(t, status).select(
        "person", "orders", month_start(F.col("first_purchase")).alias("first_month")
    )


def person_months(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Distinct (person, purchase month), from the stored person months where attached."""
    stored = t.layer("person_months")
    if stored is not None:
        return distinct_grain(_stored_activity(stored, status), "person", "month")
    return distinct_grain(
        person_orders(t, status).withColumn("month", month_start(F.col("order_purchase_timestamp"))),
        "person",
        "month",
    )


def person_days(t: Tables, status: str = DELIVERED) -> DataFrame:
    """(person, purchase day) -> orders that day."""
    return (
        person_orders(t, status)
        .groupBy("person", F.col("order_purchase_timestamp").cast("date").alias("day"))
        .agg(F.count("*").alias("orders"))
    )


def delivery_columns(sla_grain: str = "day") -> dict[str, Column]:
    """delivery_days, late_days and is_late of an order; NULL where a date is missing.

    ``sla_grain='day'`` compares dates. ``'timestamp'`` compares instants and counts
    24-hour days; it only serves to reproduce figures published before the day rule.
    """
    if sla_grain not in ("day", "timestamp"):
        raise ValueError(f"sla_grain must be 'day' or 'timestamp', not {sla_grain!r}")
    bought = F.col("order_purchase_timestamp")
    arrived = F.col("order_delivered_customer_date")
    promised = F.col("order_estimated_delivery_date")
    by_day = sla_grain == "day"
    late = arrived.cast("date") > promised.cast("date") if by_day else arrived > promised
    return {
        "delivery_days": (calendar_days if by_day else elapsed_days)(bought, arrived),
        "late_days": calendar_days(promised, arrived),
        "is_late": late,
    }


def delivery(
    orders: DataFrame,
    sla_grain: str = "day",
    need_estimate: bool = True,
    status: str = DELIVERED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Delivered orders with ``delivery_columns`` and the order columns to ``keep``."""
    columns = delivery_columns(sla_grain)
    arrivals = valid_orders(orders, status).filter("order_delivered_customer_date IS NOT NULL")
    if need_estimate:
        arrivals = arrivals.filter("order_estimated_delivery_date IS NOT NULL")
    return arrivals.select(
        "order_id", "customer_id", *keep, *[c.alias(name) for name, c in columns.items()]
    )


def payment_by_order(payments: DataFrame) -> DataFrame:
    """order_id -> paid amount in cents, number of records, distinct payment types."""
    return (
        payments.groupBy("order_id", "payment_type")
        .agg(F.sum(cents(F.col("payment_value"))).alias("paid"), F.count("*").alias("records"))
        .groupBy("order_id")
        .agg(
            F.sum("paid").alias("paid"),
            F.sum("records").alias("records"),
            F.count("payment_type").alias("payment_types"),
        )
    )
