"""Data quality: row counts, keys, statuses, NULL rates, references and domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import pct
from stallworks.operators.checks import stacked
from stallworks.operators.shaping import share_of_total
from stallworks.sources.schemas import PRIMARY_KEYS
from stallworks.sources.tables import Tables

ORDER_TIMES = {
    "purchase": "order_purchase_timestamp",
    "approved": "order_approved_at",
    "carrier": "order_delivered_carrier_date",
    "delivered": "order_delivered_customer_date",
    "estimated": "order_estimated_delivery_date",
}

SINGLE_KEY_TABLES = ("orders", "customers", "products", "sellers", "order_reviews")


def dq_row_counts(t: Tables) -> DataFrame:
    return stacked(
        [
            t[name].agg(F.count("*").alias("rows_cnt")).select(F.lit(name).alias("tbl"), "rows_cnt")
            for name in t.present()
        ]
    )


def dq_pk_duplicates(t: Tables) -> DataFrame:
    """Rows beyond the distinct keys; rows without a key are all in excess."""

    def excess(name: str) -> DataFrame:
        key = PRIMARY_KEYS[name][0]
        per_key = t[name].groupBy(key).agg(F.count("*").alias("n"))
        rows = F.coalesce(F.sum("n"), F.lit(0))
        return per_key.agg((rows - F.count(key)).alias("dup_cnt")).select(
            F.lit(f"{name}.{key}").alias("check_item"), "dup_cnt"
        )

    return stacked([excess(name) for name in SINGLE_KEY_TABLES])


def dq_status_distribution(t: Tables) -> DataFrame:
    counts = t["orders"].groupBy("order_status").agg(F.count("*").alias("order_cnt"))
    return share_of_total(counts, "order_cnt", "pct").orderBy(
        F.desc("order_cnt"), "order_status"
    )


def dq_null_rates(
    t: Tables, times: Sequence[str] = ("purchase", "approved", "delivered", "estimated")
) -> DataFrame:
    orders = t["orders"]
    return orders.agg(
        *[
            pct(F.count_if(F.col(ORDER_TIMES[name]).isNull()), F.count("*")).alias(
                f"{name}_null_pct"
            )
            for name in times
        ]
    )


def dq_orphan_orders(t: Tables) -> DataFrame:
    """Orders without a customer; a missing customer id counts as an orphan too."""
    per_customer = t["orders"].groupBy("customer_id").agg(F.count("*").alias("n"))
    return per_customer.join(
        t["customers"].select("customer_id"), "customer_id", "left_anti"
    ).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_orders"))


def dq_payment_multiplicity(t: Tables) -> DataFrame:
    per_order = t["order_payments"].groupBy("order_id").agg(F.count("*").alias("pay_cnt"))
    return per_order.groupBy("pay_cnt").agg(F.count("*").alias("order_cnt")).orderBy("pay_cnt")


def dq_score_distribution(t: Tables) -> DataFrame:
    return (
        t["order_reviews"]
        .filter(F.col("review_score").isNotNull())
        .groupBy(F.col("review_score").cast("bigint").alias("review_score"))
        .agg(F.count("*").alias("review_cnt"))
        .orderBy("review_score")
    )


def dq_price_anomalies(t: Tables) -> DataFrame:
    return t["order_items"].agg(
        F.count_if(F.col("price") < 0).alias("price_neg"),
        F.count_if(F.col("price").isNull()).alias("price_null"),
        F.count_if(F.col("freight_value") < 0).alias("freight_neg"),
        F.count_if(F.col("freight_value").isNull()).alias("freight_null"),
    )
