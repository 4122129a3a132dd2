"""Sellers: concentration, tiers, volume bands, quality risk and geography."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.functions.expressions import mean, money, pct
from stallworks.operators.grain import (
    DELIVERED,
    order_score,
    seller_order_value,
)
from stallworks.operators.ranking import tier, with_rank, with_running_sum
from stallworks.operators.shaping import band, by_band, share_of_total, top_k
from stallworks.operators.totals import seller_totals
from stallworks.sources.tables import Tables


def seller_concentration(t: Tables, k: int = 15, status: str = DELIVERED) -> DataFrame:
    """Largest sellers with share and running share (equal GMV shares one running value).

    A running share depends only on sellers of the same or a higher GMV. Sellers of equal
    GMV fold into one amount, and the k highest amounts hold all that the top k need, so
    the window runs over k rows and not over all sellers.
    """
    sellers = seller_totals(t, status)
    # Both sums, so that Spark reuses the shuffle of the main branch for the total.
    whole = sellers.agg(
        F.struct(F.sum("gmv").alias("gmv"), F.sum("orders").alias("orders"))
    ).scalar()
    top = top_k(sellers, k, F.desc("gmv"), F.col("seller_id"))
    levels = top_k(
        sellers.groupBy(F.col("gmv").alias("level")).agg(
            (F.col("level") * F.count("*")).alias("level_gmv")
        ),
        k,
        F.desc("level"),
    )
    running = levels.select(
        "level", F.sum("level_gmv").over(Window.orderBy(F.desc("level"))).alias("running")
    )
    total = whole.getField("gmv")
    return (
        top.join(F.broadcast(running), F.col("gmv").eqNullSafe(F.col("level")))  # k rows
        .orderBy(F.desc("gmv"), "seller_id")
        .select(
            "seller_id",
            money(F.col("gmv")).alias("gmv"),
            "orders",
            pct(F.col("gmv"), total).alias("gmv_pct"),
            pct(F.col("running"), total).alias("cum_pct"),
        )
    )


def seller_ranking(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Every seller with its place and the share of GMV reached up to it.

    Unlike ``seller_concentration`` this runs down the whole list, ties settled by id.
    """
    order = [F.desc_nulls_last("gmv"), F.asc("seller_id")]
    ranked = with_running_sum(
        seller_totals(t, status).select("seller_id", "gmv"), "gmv", *order, name="running"
    )
    total = ranked.agg(F.sum("gmv")).scalar()
    return ranked.select(
        "seller_id",
        money(F.col("gmv")).alias("gmv"),
        F.col("rn").alias("place"),
        pct(F.col("running"), total, 4).alias("running_pct"),
    )


def seller_tiers(
    t: Tables, head_pct: int = 2, mid_pct: int = 20, status: str = DELIVERED
) -> DataFrame:
    """Head, mid and tail sellers by GMV rank, with size and share of each tier."""
    ranked = with_rank(
        seller_totals(t, status).select("seller_id", "gmv"),
        F.desc_nulls_last("gmv"),
        F.asc("seller_id"),
    )
    sellers = ranked.agg(F.count("*")).scalar()
    labelled = ranked.withColumn(
        "tier", tier(F.col("rn"), sellers, {"head": head_pct, "mid": mid_pct}, "tail")
    )
    tiers = labelled.groupBy("tier").agg(
        F.count("*").alias("sellers"), F.sum("gmv").alias("gmv")
    )
    return (
        share_of_total(tiers, "gmv", "gmv_pct")
        .orderBy(F.desc("gmv_pct"), "tier")
        .select("tier", "sellers", money(F.col("gmv")).alias("gmv"), "gmv_pct")
    )


def seller_order_bands(
    t: Tables,
    edges: Sequence[int] = (1, 5, 20),
    labels: Sequence[str] | None = None,
    status: str = DELIVERED,
) -> DataFrame:
    names = list(labels) if labels else count_labels(edges)
    bands = by_band(
        band(seller_totals(t, status), "orders", edges, names), F.count("*").alias("sellers")
    )
    return share_of_total(bands, "sellers", "pct").orderBy("band_order")


def count_labels(edges: Sequence[int]) -> list[str]:
    """1, 2-5, 6-20, >20 for the edges 1, 5, 20."""
    labels, low = [], 1
    for edge in edges:
        labels.append(str(edge) if edge == low else f"{low}-{edge}")
        low = edge + 1
    return [*labels, f">{edges[-1]}"]


def seller_scores(t: Tables, status: str = DELIVERED) -> DataFrame:
    """seller -> gmv, orders, reviewed orders, mean order score; one pass over (seller, order)."""
    scores = order_score(t["order_reviews"]).withColumn("reviewed", F.lit(True))
    return (
        seller_order_value(t, status)
        .join(scores, "order_id", "left")
        .groupBy("seller_id")
        .agg(
            F.sum("gmv").alias("gmv"),
            F.count("*").alias("orders"),
            F.count("reviewed").alias("reviewed_orders"),
            mean(F.col("score")).alias("avg_score"),
        )
    )


def seller_quality_risk(
    t: Tables,
    min_orders: int = 10,
    score_threshold: float = 4,
    gmv_threshold: float = 30000,
    k: int = 25,
    status: str = DELIVERED,
) -> DataFrame:
    """Large sellers with low scores; the flag looks at the rounded figures shown."""
    risky = (F.col("avg_score") <= score_threshold) & (F.col("gmv") > gmv_threshold)
    rated = (
        seller_scores(t, status)
        .filter((F.col("orders") >= min_orders) & F.col("avg_score").isNotNull())
        .withColumn("gmv", money(F.col("gmv")))
        .withColumn("flag", F.when(risky, "risk").otherwise("normal"))
    )
    return top_k(rated, k, F.desc_nulls_last("gmv"), F.col("seller_id")).select(
        "seller_id", "gmv", "orders", "avg_score", "reviewed_orders", "flag"
    )


def seller_geography(t: Tables, k: int = 12) -> DataFrame:
    states = t["sellers"].groupBy(F.col("seller_state").alias("state")).agg(
        F.count("*").alias("sellers")
    )
    return top_k(
        share_of_total(states, "sellers", "pct"), k, F.desc("sellers"), F.col("state")
    )
