"""Order tables stored in buckets of the order key, so that joins of orders need no shuffle.

Orders, items, payments and reviews are hashed by ``order_id`` into equally many buckets, sorted
within each. A plan that reduces or joins them by order reads matching buckets in one task:
nothing is exchanged below the join. Grouping by person, seller or category still shuffles, but
only what the order join has left.

A bucket is one task's work and cannot be split while a query runs. A table in which a single
order holds more rows than several average buckets is therefore stored without buckets: its
joins shuffle, and adaptive execution splits the hot order.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallworks.sources.schemas import TABLE_NAMES
from stallworks.sources.tables import Tables
from stallworks.sources.warehouse import with_extras

BY_ORDER = ("orders", "order_items", "order_payments", "order_reviews")

# An order may hold as many rows as so many average buckets.
HOT_BUCKETS = 2


def has_hot_order(table: DataFrame, buckets: int, hot_buckets: float = HOT_BUCKETS) -> bool:
    """Whether one order has more rows than ``hot_buckets`` average buckets (reduced map-side)."""
    most, total = (
        table.groupBy("order_id").count().agg(F.max("count"), F.sum("count")).first()
    )
    return bool(total) and most > 1 and most * buckets > total * hot_buckets


def load_bucketed(
    t: Tables, database: str, buckets: int, hot_buckets: float = HOT_BUCKETS
) -> dict[str, bool]:
    """Fill a database from the present tables; tells which tables are stored in buckets.

    Choose ``buckets`` so that a bucket of the largest table fits a task: total bytes over some
    hundred MB. A rerun replaces the tables. They carry what stored tables copy from their
    orders as plain columns, so that the status of an order is filtered in the scan of its items.
    """
    stored = {}
    for name in t.present():
        table, target = with_extras(t, name), f"{database}.{name}"
        stored[name] = name in BY_ORDER and not has_hot_order(t[name], buckets, hot_buckets)
        if stored[name]:
            # One task per bucket, so that a bucket is one file.
            writer = (
                table.repartition(buckets, "order_id")
                .write.bucketBy(buckets, "order_id")
                .sortBy("order_id")
            )
        else:
            writer = table.write
        writer.mode("overwrite").format("parquet").saveAsTable(target)
    return stored


def read_bucketed(spark: SparkSession, database: str) -> Tables:
    present = {r.tableName for r in spark.sql(f"SHOW TABLES IN {database}").collect()}
    return Tables(
        **{
            name: partial(spark.table, f"{database}.{name}")
            for name in TABLE_NAMES
            if name in present
        }
    )
