"""The data contract: column types, keys and references of the eight business tables.

The column names are fixed values: they are the headers of the public CSV files
(including the spelling ``lenght``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ID = T.StringType()
TEXT = T.StringType()
INT = T.IntegerType()
MEASURE = T.DoubleType()
MONEY = T.DecimalType(12, 2)
WALL_CLOCK = T.TimestampNTZType()


def _table(required: tuple[str, ...], **columns: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField(name, dtype, name not in required) for name, dtype in columns.items()]
    )


SCHEMAS: dict[str, T.StructType] = {
    "category_name": _table(
        ("product_category_name",),
        product_category_name=TEXT,
        product_category_name_english=TEXT,
    ),
    "sellers": _table(
        ("seller_id",),
        seller_id=ID,
        seller_zip_code_prefix=INT,
        seller_city=TEXT,
        seller_state=TEXT,
    ),
    "products": _table(
        ("product_id",),
        product_id=ID,
        product_category_name=TEXT,
        product_name_lenght=MEASURE,
        product_description_lenght=MEASURE,
        product_photos_qty=MEASURE,
        product_weight_g=MEASURE,
        product_length_cm=MEASURE,
        product_height_cm=MEASURE,
        product_width_cm=MEASURE,
    ),
    "customers": _table(
        ("customer_id", "customer_unique_id"),
        customer_id=ID,
        customer_unique_id=ID,
        customer_zip_code_prefix=INT,
        customer_city=TEXT,
        customer_state=TEXT,
    ),
    "orders": _table(
        ("order_id", "customer_id"),
        order_id=ID,
        customer_id=ID,
        order_status=TEXT,
        order_purchase_timestamp=WALL_CLOCK,
        order_approved_at=WALL_CLOCK,
        order_delivered_carrier_date=WALL_CLOCK,
        order_delivered_customer_date=WALL_CLOCK,
        order_estimated_delivery_date=WALL_CLOCK,
    ),
    "order_items": _table(
        ("order_id", "order_item_id"),
        order_id=ID,
        order_item_id=INT,
        product_id=ID,
        seller_id=ID,
        shipping_limit_date=WALL_CLOCK,
        price=MONEY,
        freight_value=MONEY,
    ),
    "order_payments": _table(
        ("order_id", "payment_sequential"),
        order_id=ID,
        payment_sequential=INT,
        payment_type=TEXT,
        payment_installments=INT,
        payment_value=MONEY,
    ),
    "order_reviews": _table(
        ("review_id", "order_id"),
        review_id=ID,
        order_id=ID,
        review_score=INT,
        review_comment_title=TEXT,
        review_comment_message=TEXT,
        review_creation_date=WALL_CLOCK,
        review_answer_timestamp=WALL_CLOCK,
    ),
}

# Parents come before children, so loading in this order never breaks a reference.
TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "category_name": ("product_category_name",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "order_reviews": ("review_id",),
}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str

    @property
    def label(self) -> str:
        return f"{self.child}.{self.column}"


FOREIGN_KEYS: tuple[Reference, ...] = (
    Reference("orders", "customer_id", "customers"),
    Reference("order_items", "order_id", "orders"),
    Reference("order_items", "product_id", "products"),
    Reference("order_items", "seller_id", "sellers"),
    Reference("order_payments", "order_id", "orders"),
    Reference("order_reviews", "order_id", "orders"),
)

# Tables stored by month carry the month of purchase, yyyy-MM, as their partition column.
MONTH = "purchase_ym"

# Columns that stored tables carry beyond the contract. Items copy the status of their
# order, so that reports on valid items need no join; payments and reviews are stored with
# their order's month, so that a month can be read or refreshed alone. All are written together.
STORED_EXTRAS: dict[str, tuple[str, ...]] = {
    "orders": (MONTH,),
    "order_items": ("order_status", MONTH),
    "order_payments": (MONTH,),
    "order_reviews": (MONTH,),
}


def required_columns(table: str) -> tuple[str, ...]:
    """Columns that may not be NULL (key columns are always among them)."""
    return tuple(f.name for f in SCHEMAS[table].fields if not f.nullable)


def nullable_schema(table: str) -> T.StructType:
    """The schema as files deliver it: nullability is a check, not a promise."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in SCHEMAS[table].fields])


def text_schema(table: str) -> T.StructType:
    """Every column as text, for reading raw files before cleaning."""
    return T.StructType([T.StructField(f.name, TEXT, True) for f in SCHEMAS[table].fields])
