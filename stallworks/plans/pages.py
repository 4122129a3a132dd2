"""Tables behind the four report pages: one row of figures per page, one table per chart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.functions.expressions import mean, money, pct, ratio
from stallworks.operators.grain import delivery, order_score, with_labels
from stallworks.operators.totals import category_totals
from stallworks.plans import business, customers, logistics, products, reviews, sellers
from stallworks.sources.tables import Tables


def one_row(df: DataFrame):
    """A one-row result as a struct column, to be read into another one-row result."""
    return df.select(F.struct("*")).scalar()


def overview_figures(t: Tables) -> DataFrame:
    return business.biz_core_kpis(t)


def customer_figures(t: Tables) -> DataFrame:
    """Repeat rate, buyers, one-time buyers, and the repeat gap."""
    gap = one_row(customers.cust_repeat_gap(t))
    return customers.cust_repeat_rate(t).select(
        "repeat_pct",
        "buyers",
        "repeat_buyers",
        (F.col("buyers") - F.col("repeat_buyers")).alias("one_time_buyers"),
        gap.getField("median_gap").alias("median_gap"),
        gap.getField("avg_gap").alias("avg_gap"),
    )


def supply_figures(t: Tables) -> DataFrame:
    """Largest category, GMV share of head and tail sellers, and the mean score."""
    best = one_row(products.prod_category_rank(t, k=1).select("category", "gmv"))
    scores = one_row(reviews.rev_order_score_summary(t).select("avg_score", "bad_pct"))

    def of(tier: str, column: str):
        return F.max(F.when(F.col("tier") == tier, F.col(column)))

    return (
        sellers.seller_tiers(t)
        .agg(
            of("head", "gmv_pct").alias("head_gmv_pct"),
            of("head", "sellers").alias("head_sellers"),
            of("tail", "gmv_pct").alias("tail_gmv_pct"),
            of("tail", "sellers").alias("tail_sellers"),
        )
        .select(
            best.getField("category").alias("top_category"),
            best.getField("gmv").alias("top_category_gmv"),
            "head_gmv_pct",
            "head_sellers",
            "tail_gmv_pct",
            "tail_sellers",
            scores.getField("avg_score").alias("avg_score"),
            scores.getField("bad_pct").alias("bad_pct"),
        )
    )


def logistics_figures(t: Tables) -> DataFrame:
    """Delivery days, punctuality, and scores of punctual and late orders."""
    days = one_row(logistics.log_delivery_time(t))
    late = F.col("is_late")
    scored = delivery(t["orders"]).join(order_score(t["order_reviews"]), "order_id")
    scores = one_row(
        scored.agg(
            mean(F.when(~late, F.col("score"))).alias("on_time_score"),
            mean(F.when(late, F.col("score"))).alias("late_score"),
        )
    )
    return logistics.log_on_time_rate(t).select(
        days.getField("avg_days").alias("avg_days"),
        days.getField("median_days").alias("median_days"),
        days.getField("delivered").alias("delivered"),
        "on_time_pct",
        "late_pct",
        F.col("late").alias("late_orders"),
        scores.getField("on_time_score").alias("on_time_score"),
        scores.getField("late_score").alias("late_score"),
    )


def cohort_grid(t: Tables) -> DataFrame:
    """Retention of every cohort in every period up to the latest one, empty cells included.

    Periods come from the data; cohorts and periods are months, so the grid is small.
    """
    retention = customers.cust_cohort_retention(t)
    last = retention.agg(F.max("period")).scalar()
    cells = (
        retention.filter("period = 1")
        .select("first_ym", "cohort_size")
        .withColumn("period", F.explode(F.sequence(F.lit(1), last)))
    )
    found = retention.select("first_ym", "period", "retention_pct")
    return cells.join(found, ["first_ym", "period"], "left").orderBy("first_ym", "period")


def cohort_matrix(t: Tables, periods: int | None = None) -> DataFrame:
    """Retention percent per first-purchase month, one column per period.

    Without ``periods`` the widest cohort sets the width; fewer periods than the data has are
    refused. Either way one number is looked up first.
    """
    retention = customers.cust_cohort_retention(t)
    needed = retention.agg(F.coalesce(F.max("period"), F.lit(1))).first()[0]
    if periods is None:
        periods = needed
    if periods < needed:
        raise ValueError(f"the data has {needed} periods, more than {periods}")
    wide = (
        retention.groupBy("first_ym", "cohort_size")
        .pivot("period", list(range(1, periods + 1)))
        .agg(F.max("retention_pct"))
        .orderBy("first_ym")
    )
    return wide.select(
        "first_ym",
        "cohort_size",
        *[F.col(str(p)).alias(f"p{p:02d}") for p in range(1, periods + 1)],
    )


def category_scatter(t: Tables) -> DataFrame:
    """Orders against GMV for every category."""
    return with_labels(category_totals(t), t).select(
        "category",
        F.coalesce("raw_category", F.lit("")).alias("raw_category"),
        "orders",
        money(F.col("gmv")).alias("gmv"),
    )


def state_late_rates(t: Tables) -> DataFrame:
    """Late rate of every state, whatever its size."""
    return logistics.state_deliveries(t).select(
        "state",
        "orders",
        ratio(F.col("days"), F.col("dated"), 1).alias("avg_days"),
        pct(F.col("late"), F.col("orders")).alias("late_pct"),
    )


PAGES: dict[str, dict[str, Callable[[Tables], DataFrame]]] = {
    "overview": {
        "figures": overview_figures,
        "monthly_gmv": business.biz_monthly_trend,
        "top_categories": lambda t: business.biz_category_structure(t, k=10),
        "top_states": business.biz_state_performance,
    },
    "customers": {
        "figures": customer_figures,
        "frequency": customers.cust_frequency,
        "new_by_month": customers.cust_new_by_month,
        "cohort_matrix": cohort_matrix,
    },
    "products_sellers": {
        "figures": supply_figures,
        "seller_tiers": sellers.seller_tiers,
        "category_scatter": category_scatter,
        "top_products": products.prod_top_per_category,
    },
    "logistics": {
        "figures": logistics_figures,
        "days_vs_score": logistics.log_days_band_vs_score,
        "state_late_rates": state_late_rates,
    },
}


def page(t: Tables, name: str) -> dict[str, DataFrame]:
    """All tables of one page.

    Two of them do work while they are built: seller tiers write their global sort, and the
    cohort matrix looks up its width.
    """
    return {part: build(t) for part, build in PAGES[name].items()}
