"""Cleaning: raw text columns to typed tables.

Unreadable times become NULL; unreadable numbers stop the job (ANSI casts), as a wrong
amount must not pass silently. No row is dropped except repeated reviews.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.operators.grain import UNKNOWN_CATEGORY
from stallworks.sources.schemas import SCHEMAS

# Columns that raw readers may add to say where a row stood in its file.
FILE_ORDER = ("_file", "_block", "_row")


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Cast every contract column; times leniently, everything else strictly."""
    return raw.select(
        *[
            (
                F.col(f.name).try_cast(f.dataType)
                if isinstance(f.dataType, T.TimestampNTZType)
                else F.col(f.name).cast(f.dataType)
            ).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )


def clean_customers(raw: DataFrame) -> DataFrame:
    return typed(raw, "customers")


def clean_orders(raw: DataFrame) -> DataFrame:
    return typed(raw, "orders")


def clean_order_items(raw: DataFrame) -> DataFrame:
    return typed(raw, "order_items")


def clean_order_payments(raw: DataFrame) -> DataFrame:
    return typed(raw, "order_payments")


def clean_order_reviews(raw: DataFrame) -> DataFrame:
    """Keep the first row of each review id.

    "First" is the place in the files when the reader recorded it, else the earliest
    creation, answer, order and content. The filter on the row number lets Spark keep
    one candidate per id and task before the shuffle, so an id repeated without bound
    stays cheap.
    """
    if set(FILE_ORDER) <= set(raw.columns):
        order: list[Column] = [F.col(c) for c in FILE_ORDER]
    else:
        order = [
            F.col("review_creation_date").try_cast("timestamp_ntz"),
            F.col("review_answer_timestamp").try_cast("timestamp_ntz"),
            *[
                F.col(c)
                for c in (
                    "order_id",
                    "review_score",
                    "review_comment_title",
                    "review_comment_message",
                )
            ],
        ]
    first = F.row_number().over(Window.partitionBy("review_id").orderBy(*order))
    kept = raw.withColumn("_first", first).filter(F.col("_first") == 1)
    return typed(kept, "order_reviews")


def clean_products(raw: DataFrame) -> DataFrame:
    return typed(raw, "products").fillna({"product_category_name": UNKNOWN_CATEGORY})


def clean_sellers(raw: DataFrame) -> DataFrame:
    return typed(raw, "sellers")


def clean_category_name(raw: DataFrame) -> DataFrame:
    return typed(raw, "category_name")


CLEANERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "category_name": clean_category_name,
    "sellers": clean_sellers,
    "products": clean_products,
    "customers": clean_customers,
    "orders": clean_orders,
    "order_items": clean_order_items,
    "order_payments": clean_order_payments,
    "order_reviews": clean_order_reviews,
}


def duplicate_reviews(raw: DataFrame) -> DataFrame:
    """Rows before and after cleaning, and the difference. Rows without an id are one id."""
    unnamed = F.coalesce(F.max(F.col("review_id").isNull().cast("int")), F.lit(0))
    return raw.agg(
        F.count("*").alias("raw_rows"),
        (F.count_distinct("review_id") + unnamed).alias("clean_rows"),
    ).withColumn("removed_rows", F.col("raw_rows") - F.col("clean_rows"))
