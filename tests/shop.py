"""Small hand-written shops: rows by table, missing columns filled with NULL."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import types as T

from stallworks.sources.schemas import TABLE_NAMES, nullable_schema
from stallworks.sources.tables import Tables


def _value(value, dtype):
    if value is None:
        return None
    if isinstance(dtype, T.DecimalType):
        return Decimal(str(value))
    if isinstance(dtype, T.TimestampNTZType) and isinstance(value, str):
        return datetime.fromisoformat(value)
    if isinstance(dtype, T.DoubleType):
        return float(value)
    return value


def shop(spark, **rows: list[dict]) -> Tables:
    tables = {}
    for name in TABLE_NAMES:
        schema = nullable_schema(name)
        data = [
            tuple(_value(row.get(f.name), f.dataType) for f in schema.fields)
            for row in rows.get(name, [])
        ]
        tables[name] = spark.createDataFrame(data, schema)
    return Tables(**tables)


def order(order_id, bought, status="delivered", arrived=None, promised=None, customer=None):
    return {
        "order_id": order_id,
        "customer_id": customer or f"c-{order_id}",
        "order_status": status,
        "order_purchase_timestamp": bought,
        "order_delivered_customer_date": arrived,
        "order_estimated_delivery_date": promised,
    }


def customer(customer_id, person, state="SP"):
    return {"customer_id": customer_id, "customer_unique_id": person, "customer_state": state}


def item(order_id, number, price, seller="s1", product="p1", freight=1):
    return {
        "order_id": order_id,
        "order_item_id": number,
        "product_id": product,
        "seller_id": seller,
        "price": price,
        "freight_value": freight,
    }


def review(review_id, order_id, score):
    return {"review_id": review_id, "order_id": order_id, "review_score": score}


def payment(order_id, number, kind, value=1):
    return {
        "order_id": order_id,
        "payment_sequential": number,
        "payment_type": kind,
        "payment_value": value,
    }


def product(product_id, category):
    return {"product_id": product_id, "product_category_name": category}


def rows(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]
