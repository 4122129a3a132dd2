"""Measures defined once and evaluated for any dimensions and filters.

Sales and people measures share one plan: amounts are grouped by (dimensions, person,
order), then by (dimensions, person), then by dimensions. Distinct orders, distinct
people and repeat buyers are plain counts at the right step, so nothing is multiplied
by a COUNT DISTINCT expansion and each step combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import (
    cents,
    mean,
    money,
    money_ratio,
    month_label,
    pct,
    ratio,
    share_true,
)
from stallworks.operators.grain import (
    DELIVERED,
    delivery,
    delivery_columns,
    distinct_grain,
    known_valid,
    order_score,
    product_category,
    valid_orders,
)
from stallworks.operators.lattice import (
    ITEM_DIMENSIONS,
    ORDER_DIMENSIONS,
    PEOPLE,
    PERSON,
    Grain,
    serving_layer,
)
from stallworks.sources.monthly import gathered, month_date, month_of_purchase
from stallworks.sources.schemas import MONTH
from stallworks.sources.tables import Tables

PAYMENT_DIMENSIONS = ("payment_type",)

SALES_MEASURES: dict[str, Callable[[], Column]] = {
    "gmv": lambda: money(F.sum("gmv")),
    "freight": lambda: money(F.sum("freight")),
    "valid_orders": lambda: F.sum("item_orders"),
    "aov": lambda: money_ratio(F.sum("gmv"), F.sum("item_orders")),
    "buyers": lambda: F.count("person"),
    "repeat_buyers": lambda: F.count_if(F.col("orders") >= 2),
    "repeat_rate": lambda: pct(F.count_if(F.col("orders") >= 2), F.count("person")),
}

ORDER_MEASURES: dict[str, Callable[[], Column]] = {
    "delivered": lambda: F.count("delivery_days"),
    "avg_days": lambda: mean(F.col("delivery_days"), 1),
    "late_rate": lambda: share_true(F.col("is_late")),
    "avg_score": lambda: mean(F.col("score")),
}

# The same from the sums that a stored grain keeps.
STORED_ORDER_MEASURES: dict[str, Callable[[], Column]] = {
    "delivered": lambda: F.coalesce(F.sum("delivered"), F.lit(0)),
    "avg_days": lambda: ratio(F.sum("days"), F.sum("delivered"), 1),
    "late_rate": lambda: pct(F.sum("late"), F.sum("judged")),
    "avg_score": lambda: ratio(F.sum("score_sum"), F.sum("scored")),
}


def _with_customer(orders: DataFrame, t: Tables, dims: Sequence[str]) -> DataFrame:
    """Order rows with person and the wanted order-level dimensions.

    Months come from the partition column where the table is stored by month, so that a
    condition on months prunes its partitions.
    """
    people = t["customers"].select(
        "customer_id",
        F.col("customer_unique_id").alias("person"),
        F.col("customer_state").alias("state"),
        F.col("customer_city").alias("city"),
    )
    facts = orders.withColumn("ym", month_date(orders.columns)).join(people, "customer_id")
    wanted = [d for d in dims if d in ORDER_DIMENSIONS]
    others = [c for c in orders.columns if c not in ("customer_id", MONTH, *ORDER_DIMENSIONS)]
    return facts.select(*others, "person", *wanted)


def _of_months(rows: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    """Rows of an order's table; a condition on months prunes it where it is stored by month."""
    if MONTH not in rows.columns or "ym" not in filters:
        return rows
    return rows.withColumn("ym", month_date(rows.columns)).filter(filters["ym"]).drop("ym")


def _line_facts(
    t: Tables, dims: Sequence[str], filters: Mapping[str, Column], status: str | None
) -> DataFrame:
    """Items with the wanted item-level dimensions; stored items are pruned by month and status.

    Without a status the items of all orders are taken.
    """
    items = t["order_items"] if status is None else known_valid(t["order_items"], status)
    lines = _of_months(items, filters)
    if "category" in dims:
        lines = lines.join(product_category(t).select("product_id", "category"), "product_id")
    if "seller_state" in dims or "seller_city" in dims:
        lines = lines.join(t["sellers"].select("seller_id", "seller_state", "seller_city"), "seller_id")
    for dim in ITEM_DIMENSIONS:
        if dim in filters:
            lines = lines.filter(filters[dim])
    return lines


def _filtered_orders(facts: DataFrame, filters: Mapping[str, Column]) -> DataFrame:
    for dim in ORDER_DIMENSIONS:
        if dim in filters:
            facts = facts.filter(filters[dim])
    return facts


def _check(names: Sequence[str], known: Sequence[str], kind: str) -> None:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown {kind}: {unknown}; known are {list(known)}")


def _present(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    return df.withColumn("ym", month_label(F.col("ym"))) if "ym" in dims else df


def metric_table(
    t: Tables,
    measures: Sequence[str],
    dims: Sequence[str] = (),
    filters: Mapping[str, Column] | None = None,
    status: str = DELIVERED,
) -> DataFrame:
    """Sales and people measures by any dimensions.

    Without an item-level dimension, orders lacking items still make buyers; with one,
    an order belongs to the values its items have. ``filters`` maps a dimension to the
    condition it must meet, whether or not the result is split by it; months are
    compared as dates (their first day). Where an attached layer holds what is asked
    (``operators.lattice``), the smallest such layer answers, and no order or item is read.
    """
    filters = dict(filters or {})
    _check(measures, list(SALES_MEASURES), "measures")
    _check([*dims, *filters], ORDER_DIMENSIONS + ITEM_DIMENSIONS, "dimensions")
    stored = _stored(t, measures, dims, filters, status)
    if stored is None:
        used = list(dict.fromkeys([*dims, *filters]))
        facts = _people(t, dims, used, filters, status)
    else:
        facts = stored
    if stored is None or PEOPLE.intersection(measures):
        facts = facts.groupBy(*dims, PERSON).agg(
            *[F.sum(m).alias(m) for m in ("orders", "item_orders", "gmv", "freight")]
        )
    table = facts.groupBy(*dims).agg(
        *[SALES_MEASURES[m]().cast("bigint" if m in _COUNTS else "double").alias(m) for m in measures]
    )
    return _present(table, dims)


def _stored(
    t: Tables,
    measures: Sequence[str],
    dims: Sequence[str],
    filters: Mapping[str, Column],
    status: str,
) -> DataFrame | None:
    """Rows of the smallest attached layer that can answer, filtered; None if there is none.

    A condition on months prunes the stored months.
    """
    name = serving_layer(t, measures, dims, filters)
    if name is None:
        return None
    stored = t.layer(name)
    rows = valid_orders(stored, status).withColumn("ym", month_date(stored.columns))
    for condition in filters.values():
        rows = rows.filter(condition)
    return rows


def grain_table(t: Tables, grain: Grain) -> DataFrame:
    """(month, status, the grain's dimensions, its person) -> sums behind all measures.

    With item dimensions an order is one row per combination of their values and its lines are
    reduced to that first; without, orders lacking items are in it too. Delivery and score are
    summed over orders that arrived and were promised a date, as in ``service_table``. Lines are sent
    to their order once, for the sums and the join; rows of a grain with many rows are sent to
    their month at once, as sums per person hardly shrink them.
    """
    of_items = grain.of_items
    served = F.col("order_delivered_customer_date").isNotNull() & F.col(
        "order_estimated_delivery_date"
    ).isNotNull()
    placed = t["orders"].select(
        "order_id",
        "customer_id",
        "order_status",
        month_of_purchase(),
        served.alias("served"),
        *[
            F.when(served, column).alias(name)
            for name, column in delivery_columns().items()
            if name != "late_days"
        ],
    )
    orders = _with_customer(placed, t, ["ym", *grain.dims]).withColumn(
        MONTH, month_label(F.col("ym"))
    )
    lines = _line_facts(t, of_items, {}, None)
    values = (
        (lines.repartition("order_id") if of_items else lines)
        .groupBy("order_id", *of_items)
        .agg(
            F.sum(cents(F.col("price"))).alias("gmv"),
            F.sum(cents(F.col("freight_value"))).alias("freight"),
        )
        .withColumn("has_items", F.lit(1))
    )
    facts = orders.join(values, "order_id", "inner" if of_items else "left")
    facts = facts.join(order_score(t["order_reviews"]), "order_id", "left")
    facts = facts.withColumn("score", F.when(F.col("served"), F.col("score")))
    keys = [MONTH, "order_status", *grain.dims, *[PERSON] * grain.people]
    spread = []
    if grain.many_rows:
        facts, slot = gathered(facts.drop("order_id"), *keys[2:])
        spread = [slot]
    summed = facts.groupBy(*keys, *spread).agg(
        F.count("*").alias("orders"),
        F.count("has_items").alias("item_orders"),
        F.sum("gmv").alias("gmv"),
        F.sum("freight").alias("freight"),
        F.count_if("served").alias("served"),
        F.count("delivery_days").alias("delivered"),
        F.sum("delivery_days").alias("days"),
        F.count("is_late").alias("judged"),
        F.count_if("is_late").alias("late"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("scored"),
    )
    return summed.drop(*spread)


def _people(
    t: Tables,
    dims: Sequence[str],
    used: Sequence[str],
    filters: Mapping[str, Column],
    status: str,
) -> DataFrame:
    """One row per valid order and values of the dimensions, from orders and item lines."""
    of_items = [d for d in used if d in ITEM_DIMENSIONS]
    months = [c for c in (MONTH,) if c in t["orders"].columns]
    placed = valid_orders(t["orders"], status).select(
        "order_id", "customer_id", "order_purchase_timestamp", *months
    )
    facts = _with_customer(placed, t, used).drop("order_purchase_timestamp")
    orders, lines = _filtered_orders(facts, filters), _line_facts(t, of_items, filters, status)
    split = [d for d in dims if d in ITEM_DIMENSIONS]
    values = (
        lines.groupBy("order_id", *split)
        .agg(
            F.sum(cents(F.col("price"))).alias("gmv"),
            F.sum(cents(F.col("freight_value"))).alias("freight"),
        )
        .withColumn("has_items", F.lit(1))
    )
    facts = orders.join(values, "order_id", "inner" if of_items else "left")
    return facts.select(
        *dims,
        "person",
        F.lit(1).alias("orders"),
        F.coalesce("has_items", F.lit(0)).alias("item_orders"),
        "gmv",
        "freight",
    )


_COUNTS = ("valid_orders", "buyers", "repeat_buyers", "delivered")


def service_table(
    t: Tables,
    measures: Sequence[str],
    dims: Sequence[str] = (),
    filters: Mapping[str, Column] | None = None,
    sla_grain: str = "day",
    status: str = DELIVERED,
) -> DataFrame:
    """Delivery and score measures of delivered orders by any dimensions.

    By an item or payment dimension an order counts once for each value it has. Orders are
    read once: delivery is computed on the row that holds customer and month. An attached layer
    that holds what is asked answers instead, as for ``metric_table``; lateness by instants
    is in none.
    """
    filters = dict(filters or {})
    _check(measures, list(ORDER_MEASURES), "measures")
    known = ORDER_DIMENSIONS + ITEM_DIMENSIONS + PAYMENT_DIMENSIONS
    _check([*dims, *filters], known, "dimensions")
    stored = _stored(t, measures, dims, filters, status) if sla_grain == "day" else None
    if stored is not None:
        table = stored.filter("served > 0").groupBy(*dims)
        return _present(table.agg(*[STORED_ORDER_MEASURES[m]().alias(m) for m in measures]), dims)
    used = list(dict.fromkeys([*dims, *filters]))
    keep = [c for c in ("order_purchase_timestamp", MONTH) if c in t["orders"].columns]
    served = delivery(t["orders"], sla_grain, status=status, keep=keep)
    facts = _filtered_orders(_with_customer(served, t, used), filters)
    of_items = [d for d in used if d in ITEM_DIMENSIONS]
    if of_items:
        lines = _line_facts(t, of_items, filters, status)
        split = [d for d in dims if d in ITEM_DIMENSIONS]
        facts = facts.join(distinct_grain(lines, "order_id", *split), "order_id")
    of_payments = [d for d in used if d in PAYMENT_DIMENSIONS]
    if of_payments:
        paid = t["order_payments"]
        for dim in of_payments:
            paid = paid.filter(filters[dim]) if dim in filters else paid
        split = [d for d in dims if d in PAYMENT_DIMENSIONS]
        facts = facts.join(distinct_grain(paid, "order_id", *split), "order_id")
    if "avg_score" in measures:
        reviews = _of_months(t["order_reviews"], filters)
        facts = facts.join(order_score(reviews), "order_id", "left")
    table = facts.groupBy(*dims).agg(*[ORDER_MEASURES[m]().alias(m) for m in measures])
    return _present(table, dims)


def measure_table(
    t: Tables,
    measures: Sequence[str],
    dims: Sequence[str] = (),
    filters: Mapping[str, Column] | None = None,
    status: str = DELIVERED,
) -> DataFrame:
    """Sales, people and service measures side by side, by order and item dimensions.

    Each kind keeps its own grain; the two results, one row per value of the dimensions, are
    joined. A value that only one side has keeps its row, with NULL for the other side.
    """
    _check(measures, [*SALES_MEASURES, *ORDER_MEASURES], "measures")
    sales = [m for m in measures if m in SALES_MEASURES]
    service = [m for m in measures if m in ORDER_MEASURES]
    if not service:
        return metric_table(t, sales, dims, filters, status)
    if not sales:
        return service_table(t, service, dims, filters, status=status)
    one = F.lit(1).alias("_one")
    left = metric_table(t, sales, dims, filters, status).select("*", one)
    right = service_table(t, service, dims, filters, status=status).select(
        *[F.col(d).alias(f"_{d}") for d in dims], *service, F.lit(1).alias("_also")
    )
    same = F.col("_one") == F.col("_also")
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"_{d}"))
    own = [
        F.when(F.col("_one").isNotNull(), F.col(d)).otherwise(F.col(f"_{d}")).alias(d) for d in dims
    ]
    return left.join(right, same, "full").select(*own, *measures)
