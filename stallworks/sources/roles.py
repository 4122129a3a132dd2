"""Marketplace tables derived from the star-schema Parquet used for tests and benchmarks.

Every expression is whole-number or interval arithmetic on the stored columns, so that
any SQL engine derives the same rows. The mapping keeps the traps of real data: one
person behind many order-level customer ids, several item, payment and review rows per
order, NULL dates, scores and categories, untranslated and doubly used category names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallworks.sources.schemas import SCHEMAS
from stallworks.sources.tables import Tables

CUSTOMERS = [
    "o_orderkey AS customer_id",
    "o_custkey AS customer_unique_id",
    "cast(o_custkey % 100000 AS int) AS customer_zip_code_prefix",
    "c_mktsegment AS customer_city",
    "n_name AS customer_state",
]

ORDERS = [
    "o_orderkey AS order_id",
    "o_orderkey AS customer_id",
    "CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'canceled' END"
    " AS order_status",
    "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int))"
    " AS order_purchase_timestamp",
    "CASE WHEN o_orderkey % 50 <> 0"
    " THEN o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 + 1 AS int)) END"
    " AS order_approved_at",
    "CASE WHEN o_orderkey % 40 <> 0 THEN o_orderdate + make_dt_interval(1) END"
    " AS order_delivered_carrier_date",
    "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 97 <> 0"
    " THEN o_orderdate + make_dt_interval(cast(1 + (o_orderkey * 7) % 30 AS int), 10) END"
    " AS order_delivered_customer_date",
    "o_orderdate + make_dt_interval(cast(8 + o_custkey % 20 AS int))"
    " AS order_estimated_delivery_date",
]

PRICE = (
    "cast(cast(floor(l_extendedprice / 1000) AS int) + l_linenumber * 0.01 AS decimal(12,2))"
)

ORDER_ITEMS = [
    "l_orderkey AS order_id",
    "l_linenumber AS order_item_id",
    "l_partkey AS product_id",
    "l_suppkey AS seller_id",
    "l_shipdate AS shipping_limit_date",
    f"{PRICE} AS price",
    "cast(l_quantity AS decimal(12,2)) AS freight_value",
]

ORDER_PAYMENTS = [
    "l_orderkey AS order_id",
    "l_linenumber AS payment_sequential",
    "CASE l_returnflag WHEN 'A' THEN 'credit_card' WHEN 'N' THEN 'boleto' ELSE 'voucher' END"
    " AS payment_type",
    "l_linenumber AS payment_installments",
    f"{PRICE} AS payment_value",
]

ORDER_REVIEWS = [
    "event_id AS review_id",
    "event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END AS order_id",
    "CASE WHEN event_type <> 'error' THEN cast(1 + floor(value) % 5 AS int) END AS review_score",
    "event_type AS review_comment_title",
    "props AS review_comment_message",
    "ts AS review_creation_date",
    "ts + make_dt_interval(cast(event_id % 3 AS int)) AS review_answer_timestamp",
]

PRODUCTS = [
    "p_partkey AS product_id",
    "CASE WHEN p_size <> 1 THEN p_brand END AS product_category_name",
    "cast(length(p_name) AS double) AS product_name_lenght",
    "cast(p_size AS double) AS product_weight_g",
]

SELLERS = [
    "s_suppkey AS seller_id",
    "cast(s_suppkey % 100000 AS int) AS seller_zip_code_prefix",
    "s_name AS seller_city",
    "n_name AS seller_state",
]

CATEGORY_NAME = [
    "p_brand AS product_category_name",
    "'cat_' || cast(cast(substring(p_brand, 7) AS int) % 20 AS string)"
    " AS product_category_name_english",
]


# Types of the stored columns in use. Naming them spares a footer-reading job per file.
SOURCES = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "events": "event_id bigint, ts timestamp_ntz, event_type string, value double, props string",
}


def role_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def source(name: str) -> DataFrame:
        return spark.read.schema(SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")

    def with_nation(df: DataFrame, key: str) -> DataFrame:
        return df.join(source("nation"), F.col(key) == F.col("n_nationkey"))

    def customers() -> DataFrame:
        buyers = source("orders").join(
            source("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return with_nation(buyers, "c_nationkey").selectExpr(*CUSTOMERS)

    def category_name() -> DataFrame:
        brands = source("part").select("p_brand").distinct()
        return brands.filter(F.col("p_brand") != "Brand#25").selectExpr(*CATEGORY_NAME)

    return Tables(
        customers=customers,
        orders=lambda: source("orders").selectExpr(*ORDERS),
        order_items=lambda: source("lineitem").selectExpr(*ORDER_ITEMS),
        order_payments=lambda: source("lineitem").selectExpr(*ORDER_PAYMENTS),
        order_reviews=lambda: source("events").selectExpr(*ORDER_REVIEWS),
        products=lambda: source("part").selectExpr(*PRODUCTS),
        sellers=lambda: with_nation(source("supplier"), "s_nationkey").selectExpr(*SELLERS),
        category_name=category_name,
    )


def whole_row(df: DataFrame, name: str) -> DataFrame:
    """All columns of the raw file in order; those the source lacks are empty."""
    return df.select(
        *[
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
            for c in SCHEMAS[name].names
        ]
    )


def as_text(moment: str) -> str:
    return f"substring(cast({moment} AS string), 1, 19)"


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The same tables as text, as raw files would deliver them, with dirt to clean:
    unreadable and empty times, zero-padded zips, repeated review ids."""
    t = role_tables(spark, sf_dir)
    order_key = F.col("order_id")
    orders = t["orders"].select(
        *[
            F.col(c).cast("string").alias(c) if not c.endswith(("_timestamp", "_at", "_date"))
            else F.expr(as_text(c)).alias(c)
            for c in t["orders"].columns
        ]
    )
    orders = orders.withColumn(
        "order_approved_at",
        F.when(order_key.cast("bigint") % 50 == 1, "not a date").otherwise(F.col("order_approved_at")),
    ).withColumn(
        "order_delivered_carrier_date",
        F.when(order_key.cast("bigint") % 40 == 0, "").otherwise(
            F.col("order_delivered_carrier_date")
        ),
    )
    reviews = t["order_reviews"].selectExpr(
        "cast(order_id AS string) AS review_id",
        "cast(order_id AS string) AS order_id",
        "cast(review_score AS string) AS review_score",
        "review_comment_title",
        "review_comment_message",
        f"{as_text('review_creation_date')} AS review_creation_date",
        "CASE WHEN review_id % 100 = 3 THEN 'n/a'"
        f" ELSE {as_text('review_answer_timestamp')} END AS review_answer_timestamp",
    )

    def text(df: DataFrame, **changed: str) -> DataFrame:
        return df.select(
            *[
                F.expr(changed[c]).alias(c) if c in changed else F.col(c).cast("string").alias(c)
                for c in df.columns
            ]
        )

    raw = {
        "customers": text(
            t["customers"],
            customer_zip_code_prefix="lpad(cast(customer_zip_code_prefix AS string), 5, '0')",
        ),
        "orders": orders,
        "order_items": text(
            t["order_items"], shipping_limit_date=as_text("shipping_limit_date")
        ),
        "order_payments": text(t["order_payments"]),
        "order_reviews": reviews,
        "products": text(t["products"]),
        "sellers": text(
            t["sellers"],
            seller_zip_code_prefix="lpad(cast(seller_zip_code_prefix AS string), 5, '0')",
        ),
        "category_name": text(t["category_name"]),
    }
    return {name: whole_row(df, name) for name, df in raw.items()}
