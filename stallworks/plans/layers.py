"""Stored layers, refreshed month by month: order facts, and additive monthly summaries.

Reports over attached layers read the summaries instead of the item lines (see
``operators.totals``). Distinct people do not add up across months, but a person's months do:
``person_months`` answers buyers, repeat purchase, cohorts and activity. Medians and ranks are
taken from the orders. Any other group-by of the measures can be stored as a grain
(``operators.lattice``), refreshed and attached by its name. Every layer keeps fingerprints of the rows it was made from, so a changed
price, a late review or a moved category makes the months stale that it touches, and
refreshing one layer leaves the others as stale as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallworks.functions.expressions import pct, ratio
from stallworks.operators.grain import (
    DELIVERED,
    category_lines,
    delivery_columns,
    order_score,
    order_value,
    product_lines,
    seller_lines,
    valid_orders,
)
from stallworks.operators.lattice import Grain, grain_of
from stallworks.operators.ranking import written
from stallworks.plans.metrics import grain_table
from stallworks.sources.fingerprints import Part, different_months, fingerprints, whole_table
from stallworks.sources.monthly import (
    Month,
    among,
    gathered,
    month_of_purchase,
    read_monthly,
    refuse_half_moves,
    replace_months,
)
from stallworks.sources.schemas import MONTH, STORED_EXTRAS
from stallworks.sources.tables import Tables


def order_months(t: Tables) -> DataFrame:
    return t["orders"].select("order_id", "customer_id", "order_status", month_of_purchase())


def order_facts(t: Tables) -> DataFrame:
    """One row per order of any status: amounts, score, delivery, and the purchase month.

    Delivery is computed on the order's own row, for delivered orders that arrived.
    """
    arrived = (F.col("order_status") == DELIVERED) & F.col(
        "order_delivered_customer_date"
    ).isNotNull()
    served = delivery_columns()
    return (
        t["orders"]
        .select(
            "order_id",
            "customer_id",
            "order_status",
            month_of_purchase(),
            *[F.when(arrived, served[c]).alias(c) for c in ("delivery_days", "is_late")],
        )
        .join(order_value(t["order_items"]), "order_id", "left")
        .join(order_score(t["order_reviews"]), "order_id", "left")
    )


def month_summary(t: Tables) -> DataFrame:
    """(month, status) -> additive sums, from the stored facts where they are attached."""
    stored = t.layer("order_facts")
    facts = order_facts(t) if stored is None else stored
    return facts.groupBy(MONTH, "order_status").agg(
        F.count("*").alias("placed_orders"),
        F.count("units").alias("orders"),
        F.sum("gmv").alias("gmv"),
        F.sum("freight").alias("freight"),
        F.count("is_late").alias("eligible"),
        F.count_if("is_late").alias("late"),
        F.sum("score").alias("score_sum"),
        F.count("score").alias("scored_orders"),
    )


def by_month(
    t: Tables, reduce: Callable[[DataFrame], DataFrame], key: str, spread: bool = True
) -> DataFrame:
    """(key, month, status) -> distinct orders and sums, from items reduced to (key, order).

    Items are sent to their order once, for the reduction and the join. With ``spread`` the lines
    are then sent to their month and slot at once, for the sums and for writing by month.
    """
    lines = reduce(t["order_items"])
    measures = [c for c in lines.columns if c not in (key, "order_id")]
    found = lines.join(order_months(t).drop("customer_id"), "order_id").drop("order_id")
    slot = []
    if spread:
        found, name = gathered(found, key)
        slot = [name]
    return (
        found.groupBy(key, MONTH, "order_status", *slot)
        .agg(F.count("*").alias("orders"), *[F.sum(m).alias(m) for m in measures])
        .drop(*slot)
    )


def person_month_orders(t: Tables) -> DataFrame:
    """(person, month, status) -> orders, those with items, and their amounts in cents."""
    people = t["customers"].select("customer_id", F.col("customer_unique_id").alias("person"))
    measures = ("orders", "item_orders", "gmv", "freight")
    per_customer = (
        order_months(t)
        .join(order_value(t["order_items"]), "order_id", "left")
        .groupBy("customer_id", MONTH, "order_status")
        .agg(
            F.count("*").alias("orders"),
            F.count("units").alias("item_orders"),
            F.sum("gmv").alias("gmv"),
            F.sum("freight").alias("freight"),
        )
    )
    found, slot = gathered(per_customer.join(people, "customer_id").drop("customer_id"), "person")
    return (
        found.groupBy("person", MONTH, "order_status", slot)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .drop(slot)
    )


LAYERS: dict[str, Callable[[Tables], DataFrame]] = {
    "order_facts": order_facts,
    "month_summary": month_summary,
    "seller_months": lambda t: by_month(t, partial(seller_lines, together=True), "seller_id"),
    "category_months": lambda t: by_month(
        t,
        partial(category_lines, products=t["products"], together=True),
        "raw_category",
        spread=False,
    ),
    "product_months": lambda t: by_month(t, partial(product_lines, together=True), "product_id"),
    "person_months": person_month_orders,
}


# Layers whose rows come gathered by month.
_ARRANGED = ("seller_months", "product_months", "person_months")

# What a layer is made from. Its fingerprint tells, month by month, whether it still is.
_ORDER_PARTS: dict[str, Part] = {
    "orders": whole_table("orders"),
    "values": ("order_items", ("order_id", "price", "freight_value")),
    "scores": ("order_reviews", ("order_id", "review_score")),
}
_STATUS: dict[str, Part] = {"status": ("orders", ("order_id", "order_status"))}
LAYER_PARTS: dict[str, dict[str, Part]] = {
    "order_facts": _ORDER_PARTS,
    "month_summary": _ORDER_PARTS,
    "seller_months": _STATUS
    | {"sellers": ("order_items", ("order_id", "seller_id", "price"))},
    "category_months": _STATUS
    | {
        "categories": (
            "order_items", ("order_id", "product_category_name", "price", "freight_value"),
        )
    },
    "product_months": _STATUS
    | {"products": ("order_items", ("order_id", "product_id", "price"))},
    "person_months": {
        "people": ("orders", ("order_id", "order_status", "customer_unique_id")),
        "values": _ORDER_PARTS["values"],
    },
}

# Where the fingerprints of a layer are kept, beside it.
SEEN = "seen"

# What a grain is made from beside orders, amounts and scores, if it has one of these dimensions.
_LOOKED_UP: dict[str, Part] = {
    "buyers": (
        "orders",
        ("order_id", "has_customer", "customer_unique_id", "customer_state", "customer_city"),
    ),
    "products": ("order_items", ("order_id", "product_id", "price", "freight_value")),
    "categories_shown": (
        "order_items",
        (
            "order_id",
            "has_product",
            "product_category_name",
            "product_category_name_english",
            "price",
            "freight_value",
        ),
    ),
    "sellers": ("order_items", ("order_id", "seller_id", "price", "freight_value")),
    "seller_places": (
        "order_items",
        ("order_id", "has_seller", "seller_state", "seller_city", "price", "freight_value"),
    ),
}
_SEEN_BY = {
    "product_id": "products",
    "category": "categories_shown",
    "seller_id": "sellers",
    "seller_state": "seller_places",
    "seller_city": "seller_places",
}


def _grain_parts(grain: Grain) -> dict[str, Part]:
    """Every grain leaves out orders without a customer, so all look at buyers.

    Parts by item dimensions hold the amounts too, which then need no part of their own.
    """
    seen = {"buyers", *[_SEEN_BY[d] for d in grain.of_items]}
    of_orders = {p: what for p, what in _ORDER_PARTS.items() if p != "values" or not grain.of_items}
    return of_orders | {f"{part}_of_grain": _LOOKED_UP[part] for part in sorted(seen)}


def _layer(name: str) -> Callable[[Tables], DataFrame]:
    grain = grain_of(name)
    return LAYERS[name] if grain is None else partial(grain_table, grain=grain)


def _is_arranged(name: str) -> bool:
    grain = grain_of(name)
    return name in _ARRANGED if grain is None else grain.many_rows


def layer_parts(name: str) -> dict[str, Part]:
    grain = grain_of(name)
    return LAYER_PARTS[name] if grain is None else _grain_parts(grain)


def _parts(names: Sequence[str]) -> dict[str, Part]:
    """Parts of several layers under one name for equal parts, so that each is computed once."""
    return {part: what for name in names for part, what in layer_parts(name).items()}


def layer_marks(t: Tables, names: Sequence[str] = tuple(LAYERS)) -> DataFrame:
    """Fingerprints of all that the named layers are made from, written once.

    Handed to ``stale_layers`` and then to ``refresh_layers`` they spare scanning the same tables
    again. Rows that change after they were taken make their months stale.
    """
    return written(fingerprints(t, _parts(names)))


def refresh_layers(
    t: Tables,
    folder: str,
    months: Sequence[Month] | None = None,
    names: Sequence[str] = tuple(LAYERS),
    marks: DataFrame | None = None,
) -> None:
    """Write the named layers whole, or replace only the named ``months``.

    Names are those of ``LAYERS`` and of grains, ``grain(["state"], people=True).name``.
    A named month that has no rows any more is emptied; None names the rows without a month.
    An order that changed month needs both named, which is checked against the stored order
    facts. On tables stored by month, only the named months of orders, items and reviews
    are read. ``marks`` are the ``layer_marks`` of these tables, if they were taken before.
    """
    spark = t["orders"].sparkSession

    def chosen(name: str) -> DataFrame:
        table = t[name]
        if months is None or MONTH not in table.columns:
            return table
        return table.filter(among(F.col(MONTH), months))

    present = [n for n in STORED_EXTRAS if n in t.present()]
    pruned = t.replaced(**{name: chosen(name) for name in present})
    before = _stored(spark, f"{folder}/order_facts") if months is not None else None
    if before is not None and "order_facts" in names:
        refuse_half_moves(order_months(t), before, months)
    marks = layer_marks(pruned, names) if marks is None else marks
    for name in names:
        layer = _layer(name)(pruned)
        made_from = marks.filter(F.col("part").isin(list(layer_parts(name))))
        if months is not None:
            layer = layer.filter(among(F.col(MONTH), months))
            made_from = made_from.filter(among(F.col(MONTH), months))
        # The mark goes last: a refresh that fails half-way leaves the months stale.
        replace_months(layer, f"{folder}/{name}", months, _is_arranged(name))
        _store_marks(made_from, f"{folder}/{SEEN}/{name}", months)
        if name == "order_facts":
            pruned = attach_layers(pruned, spark, folder, [name], verify=False)


def _store_marks(marks: DataFrame, path: str, months: Sequence[Month] | None) -> None:
    """Fingerprints in one file, a row per part and month; those of other months stay.

    A failure while the file is replaced leaves none, which ``stale_layers`` refuses.
    """
    before = _stored(marks.sparkSession, path) if months is not None else None
    if before is not None:
        marks = written(before.filter(~among(F.col(MONTH), months)).unionByName(marks))
    marks.coalesce(1).write.mode("overwrite").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_monthly(spark, path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return None


def read_layer(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_monthly(spark, f"{folder}/{name}")


def stale_layers(
    t: Tables,
    spark: SparkSession,
    folder: str,
    names: Sequence[str] | None = None,
    marks: DataFrame | None = None,
) -> dict[str, list[Month]]:
    """Months in which a stored layer was made from other rows than these; by layer.

    Without ``names`` all of ``LAYERS`` that are stored; grains are named. The source tables are
    read once for all, or not at all where their ``layer_marks`` are given.
    """
    asked = LAYERS if names is None else names
    found = {name: _stored(spark, f"{folder}/{SEEN}/{name}") for name in asked}
    missing = [name for name, seen in found.items() if seen is None]
    if names is not None and missing:
        raise ValueError(f"layers {missing} are not stored in {folder}")
    seen = {name: table for name, table in found.items() if table is not None}
    if not seen:
        return {}
    now = layer_marks(t, list(seen)) if marks is None else marks
    return {
        name: different_months(now.filter(F.col("part").isin(list(layer_parts(name)))), before)
        for name, before in seen.items()
    }


def stale_months(
    t: Tables,
    spark: SparkSession,
    folder: str,
    names: Sequence[str] | None = None,
    marks: DataFrame | None = None,
) -> list[Month]:
    """Months in which any of the stored layers has to be refreshed."""
    stale = stale_layers(t, spark, folder, names, marks)
    return sorted({month for months in stale.values() for month in months}, key=str)


def attach_layers(
    t: Tables,
    spark: SparkSession,
    folder: str,
    names: Sequence[str] = tuple(LAYERS),
    verify: bool = True,
) -> Tables:
    """The tables with stored layers, from which totals are then read.

    Layers made from other rows than these are refused, which scans the columns that the layers
    are made from; ``verify=False`` takes them as they are, for instance when only some months
    were stored.
    """
    if verify:
        stale = {n: months for n, months in stale_layers(t, spark, folder, names).items() if months}
        if stale:
            raise ValueError(f"layers are stale; refresh the months {stale}")
    # Counts of stored rows come from the footers of files; only grains compete by size.
    sized = [n for n in names if grain_of(n) is not None or n == "person_months"]
    rows = {n: read_layer(spark, folder, n).count() for n in sized} if len(sized) > 1 else {}
    return t.with_layers(
        rows, **{name: partial(read_layer, spark, folder, name) for name in names}
    )


def monthly_service(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Late rate and mean score per month, read from the stored summary."""
    summary = t.layer("month_summary")
    if summary is None:
        raise KeyError("attach the layer 'month_summary' first")
    return (
        valid_orders(summary, status)
        .groupBy(F.col(MONTH).alias("ym"))
        .agg(*[F.sum(c).alias(c) for c in ("eligible", "late", "score_sum", "scored_orders")])
        .orderBy("ym")
        .select(
            "ym",
            "eligible",
            pct(F.col("late"), F.col("eligible")).alias("late_pct"),
            "scored_orders",
            ratio(F.col("score_sum"), F.col("scored_orders")).alias("avg_score"),
        )
    )
