"""Products and categories: ranks, concentration, best sellers, freight, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.functions.expressions import (
    money,
    money_ratio,
    pct,
    quotient,
    ratio,
    rounded,
)
from stallworks.operators.grain import (
    DELIVERED,
    category_order_value,
    order_score,
    product_category,
    with_labels,
)
from stallworks.operators.shaping import top_k, top_k_per_group, whole
from stallworks.operators.totals import category_totals, product_totals
from stallworks.sources.tables import Tables


def prod_category_rank(t: Tables, k: int = 20, status: str = DELIVERED) -> DataFrame:
    ranked = with_labels(category_totals(t, status), t).select(
        "*",
        F.rank().over(Window.orderBy(F.desc("gmv"))).cast("bigint").alias("gmv_rank"),
        F.dense_rank().over(Window.orderBy(F.desc("units"))).cast("bigint").alias("units_rank"),
    )
    return top_k(ranked, k, F.desc("gmv"), F.col("category"), F.col("raw_category")).select(
        "category",
        "orders",
        money(F.col("gmv")).alias("gmv"),
        "units",
        money_ratio(F.col("gmv"), F.col("orders")).alias("gmv_per_order"),
        ratio(F.col("units"), F.col("orders")).alias("units_per_order"),
        "gmv_rank",
        "units_rank",
    )


def prod_category_concentration(t: Tables, k: int = 10, status: str = DELIVERED) -> DataFrame:
    """Share and running share; categories with equal GMV share one running value."""
    total = F.sum("gmv").over(whole())
    running = F.sum("gmv").over(Window.orderBy(F.desc("gmv")))
    shared = with_labels(category_totals(t, status), t, fallback=None).select(
        "category",
        "raw_category",
        "gmv",
        pct(F.col("gmv"), total).alias("gmv_pct"),
        pct(running, total).alias("cum_pct"),
    )
    return top_k(shared, k, F.desc("gmv"), F.col("category"), F.col("raw_category")).select(
        "category", money(F.col("gmv")).alias("gmv"), "gmv_pct", "cum_pct"
    )


def prod_top_per_category(
    t: Tables, per_group: int = 1, k: int = 15, status: str = DELIVERED
) -> DataFrame:
    """Best products of each category by orders, then the largest of those by GMV."""
    labelled = product_totals(t, status).join(
        product_category(t, fallback=None).select("product_id", "category"), "product_id"
    )
    best = top_k_per_group(
        labelled, ["category"], per_group, F.desc("orders"), F.desc("gmv"), F.col("product_id")
    )
    return top_k(best, k, F.desc("gmv"), F.col("product_id")).select(
        "category", "product_id", "orders", money(F.col("gmv")).alias("gmv")
    )


def prod_freight_sensitivity(
    t: Tables, min_orders: int = 50, k: int = 15, status: str = DELIVERED
) -> DataFrame:
    """Mean freight against mean price per category."""
    price = quotient(money(F.col("gmv")), F.col("priced"))
    freight = quotient(money(F.col("freight")), F.col("freighted"))
    rated = (
        with_labels(category_totals(t, status), t, fallback=None)
        .filter(F.col("orders") >= min_orders)
        .select(
            "category",
            "raw_category",
            rounded(price, 2).alias("avg_price"),
            rounded(freight, 2).alias("avg_freight"),
            pct(freight, price, 1).alias("freight_pct"),
        )
    )
    return top_k(
        rated, k, F.desc_nulls_last("freight_pct"), F.col("category"), F.col("raw_category")
    ).drop("raw_category")


def prod_category_score(
    t: Tables, min_orders: int = 30, k: int = 20, status: str = DELIVERED
) -> DataFrame:
    """Order scores averaged per category, weighted by item lines (an order with two
    lines in a category counts twice; ``rev_category_score`` weighs orders equally)."""
    scored = (
        category_order_value(t, status)
        .join(order_score(t["order_reviews"]).filter(F.col("score").isNotNull()), "order_id")
        .groupBy("raw_category")
        .agg(
            F.count("*").alias("orders"),
            F.sum("gmv").alias("gmv"),
            F.sum(F.col("score") * F.col("units")).alias("score_sum"),
            F.sum("units").alias("units"),
        )
        .filter(F.col("orders") >= min_orders)
    )
    return top_k(
        with_labels(scored, t), k, F.desc("orders"), F.col("category"), F.col("raw_category")
    ).select(
        "category",
        "orders",
        money(F.col("gmv")).alias("gmv"),
        ratio(F.col("score_sum"), F.col("units")).alias("avg_score"),
    )
