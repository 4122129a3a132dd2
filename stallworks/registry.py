"""Every query by name, as ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.functions.expressions import clock_text, money, month_label, month_start
from stallworks.operators import checks, cleaning, grain, lattice
from stallworks.operators.ranking import own_folder
from stallworks.plans import (
    business,
    customers,
    derived,
    layers,
    logistics,
    metrics,
    pages,
    products,
    profiling,
    quality,
    reviews,
    sellers,
)
from stallworks.sources import bucketed, raw_csv, warehouse
from stallworks.sources.formats import CSV
from stallworks.sources.roles import raw_tables, role_tables
from stallworks.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
Plan = Callable[[Tables], DataFrame]

SALES = list(metrics.SALES_MEASURES)
SERVICE = list(metrics.ORDER_MEASURES)

PLANS: dict[str, Plan] = {
    plan.__name__: plan
    for plan in (
        quality.dq_row_counts,
        quality.dq_pk_duplicates,
        quality.dq_status_distribution,
        quality.dq_null_rates,
        quality.dq_orphan_orders,
        quality.dq_payment_multiplicity,
        quality.dq_score_distribution,
        quality.dq_price_anomalies,
        business.biz_core_kpis,
        business.biz_all_vs_delivered,
        business.biz_monthly_trend,
        business.biz_monthly_mom,
        business.biz_state_performance,
        business.biz_category_structure,
        customers.cust_id_vs_person,
        customers.cust_frequency,
        customers.cust_repeat_rate,
        customers.cust_new_by_month,
        customers.cust_repeat_gap,
        customers.cust_cohort_retention,
        customers.cust_rfm,
        products.prod_category_rank,
        products.prod_category_concentration,
        products.prod_top_per_category,
        products.prod_freight_sensitivity,
        products.prod_category_score,
        sellers.seller_concentration,
        sellers.seller_tiers,
        sellers.seller_order_bands,
        sellers.seller_quality_risk,
        sellers.seller_geography,
        sellers.seller_ranking,
        logistics.log_delivery_time,
        logistics.log_on_time_rate,
        logistics.log_late_bands,
        logistics.log_state,
        logistics.log_seller,
        logistics.log_days_band_vs_score,
        logistics.log_on_time_vs_score,
        reviews.rev_order_score_summary,
        reviews.rev_value_band_vs_score,
        reviews.rev_payment_vs_score,
        reviews.rev_category_score,
        derived.gmv_inflation,
        derived.freight_ratio,
        derived.active_by_month,
        derived.rfm_segments,
        derived.tier_by_cum_share,
        derived.seller_health,
        derived.category_new_buyers,
        derived.monthly_yoy,
        derived.payments_per_order,
    )
}

# The business reports of the analysis proper; the benchmark times these.
REPORTS = [n for n in PLANS if n.split("_")[0] in ("dq", "biz", "cust", "prod", "log", "rev")] + [
    n for n in PLANS if n.startswith("seller_") and n not in ("seller_health", "seller_ranking")
]

DERIVED = [n for n, plan in PLANS.items() if plan.__module__ == derived.__name__]

GRAINS: dict[str, Plan] = {
    "grain_valid_orders": lambda t: grain.valid_orders(t["orders"]).select(
        "order_id", "customer_id", _purchase_month()
    ),
    "grain_order_value": lambda t: _in_currency(grain.order_value(t["order_items"])),
    "grain_order_score": lambda t: grain.order_score(t["order_reviews"]),
    "grain_seller_orders": lambda t: _in_currency(grain.seller_order_value(t)),
    "grain_category_orders": grain.label_orders,
    "grain_payment_types": lambda t: grain.distinct_grain(
        t["order_payments"], "order_id", "payment_type"
    ),
    "grain_delivery": lambda t: grain.delivery(t["orders"]).select(
        "order_id", "delivery_days", "late_days", F.col("is_late").cast("int").alias("is_late")
    ),
    "grain_category_label": grain.product_category,
    "grain_person_orders": lambda t: grain.person_orders(t).select(
        "person", "order_id", _purchase_month()
    ),
}


def _purchase_month():
    return month_label(month_start(F.col("order_purchase_timestamp"))).alias("ym")


def _in_currency(df: DataFrame) -> DataFrame:
    amounts = [c for c in ("gmv", "freight") if c in df.columns]
    return df.withColumns({c: money(F.col(c)) for c in amounts})


CHECKS: dict[str, Plan] = {
    "check_primary_keys": checks.primary_key_check,
    "check_foreign_keys": checks.foreign_key_check,
    "check_not_null": checks.not_null_check,
    "check_domains": checks.domain_check,
}

VARIANTS: dict[str, Plan] = CHECKS | {
    "prod_top5_per_category": partial(products.prod_top_per_category, per_group=5, k=100),
    "seller_order_bands_wide": partial(sellers.seller_order_bands, edges=(160, 180, 200)),
    "seller_quality_risk_strict": partial(
        sellers.seller_quality_risk, score_threshold=3, gmv_threshold=10400
    ),
    "log_on_time_rate_timestamp": partial(logistics.log_on_time_rate, sla_grain="timestamp"),
    "log_on_time_vs_score_timestamp": partial(
        logistics.log_on_time_vs_score, sla_grain="timestamp"
    ),
    "eda_table_profile": profiling.table_profile,
    "eda_order_profile": profiling.order_profile,
    "eda_status_counts": profiling.status_counts,
    "eda_multi_review_orders": profiling.multi_review_orders,
    "eda_payment_split": profiling.payment_split,
    "eda_sales_check": profiling.sales_check,
    "eda_repeat_check": profiling.repeat_check,
    "eda_late_score_check": profiling.late_score_check,
    "metric_sales_total": partial(metrics.metric_table, measures=SALES),
    "metric_sales_by_month": partial(metrics.metric_table, measures=SALES, dims=["ym"]),
    "metric_sales_by_state": partial(metrics.metric_table, measures=SALES, dims=["state"]),
    "metric_sales_by_category": partial(metrics.metric_table, measures=SALES, dims=["category"]),
    "metric_sales_by_seller_state_month": partial(
        metrics.metric_table, measures=SALES, dims=["seller_state", "ym"]
    ),
    "metric_sales_filtered": lambda t: metrics.metric_table(
        t, SALES, ["ym"], {"state": F.col("state") == "NATION_3"}
    ),
    "metric_service_total": partial(metrics.service_table, measures=SERVICE),
    "metric_service_by_state": partial(metrics.service_table, measures=SERVICE, dims=["state"]),
    "metric_service_by_month": partial(metrics.service_table, measures=SERVICE, dims=["ym"]),
    "metric_service_by_category": partial(
        metrics.service_table, measures=SERVICE, dims=["category"]
    ),
    "metric_service_by_payment_type": partial(
        metrics.service_table, measures=SERVICE, dims=["payment_type"]
    ),
    "metric_all_by_seller_state": partial(
        metrics.measure_table, measures=SALES + SERVICE, dims=["seller_state"]
    ),
    "page_overview_figures": pages.overview_figures,
    "page_customer_figures": pages.customer_figures,
    "page_supply_figures": pages.supply_figures,
    "page_logistics_figures": pages.logistics_figures,
    "page_top_categories": pages.PAGES["overview"]["top_categories"],
    "page_cohort_matrix": pages.cohort_grid,
    "page_category_scatter": pages.category_scatter,
    "page_state_late_rates": pages.state_late_rates,
}


# Reports answered from tables stored by month, and the tables they need.
SALES_TABLES = ("orders", "order_items")
KPI_TABLES = (*SALES_TABLES, "customers", "sellers", "products")
CATEGORY_TABLES = (*SALES_TABLES, "products", "category_name")
FROM_WAREHOUSE: dict[str, tuple[Plan, tuple[str, ...]]] = {
    "warehouse_monthly_trend": (business.biz_monthly_trend, SALES_TABLES),
    "warehouse_category_rank": (products.prod_category_rank, CATEGORY_TABLES),
    "warehouse_seller_concentration": (sellers.seller_concentration, SALES_TABLES),
    "warehouse_category_score": (reviews.rev_category_score, (*CATEGORY_TABLES, "order_reviews")),
    "warehouse_core_kpis": (business.biz_core_kpis, KPI_TABLES),
    "warehouse_metric_month": (
        lambda t: metrics.metric_table(
            t, SALES, ["ym"], {"ym": F.col("ym") == F.lit("1996-03-01").cast("date")}
        ),
        (*SALES_TABLES, "customers"),
    ),
}

# The same after orders have gone and moved: stored once as they were, then again as they are.
RELOADED: dict[str, tuple[Plan, tuple[str, ...], bool]] = {
    "warehouse_reload_monthly_trend": (business.biz_monthly_trend, SALES_TABLES, False),
    "warehouse_reload_category_score": (
        reviews.rev_category_score, (*CATEGORY_TABLES, "order_reviews"), False
    ),
    "warehouse_months_core_kpis": (business.biz_core_kpis, KPI_TABLES, True),
}
REFRESHED: dict[str, tuple[Plan, tuple[str, ...]]] = {
    "layer_refresh_monthly_trend": (business.biz_monthly_trend, ("order_facts", "month_summary")),
    "layer_refresh_seller_tiers": (sellers.seller_tiers, ("seller_months",)),
    "layer_refresh_monthly_service": (layers.monthly_service, ("month_summary",)),
    "layer_refresh_cohort_retention": (customers.cust_cohort_retention, ("person_months",)),
    "layer_refresh_repeat_rate": (customers.cust_repeat_rate, ("person_months",)),
}

# Rows were corrected, or came late, since tables and layers were stored: what was stored first
# lacks the corrections, and only the months in which anything differs are replaced.
CORRECTED: dict[str, tuple[Plan, tuple[str, ...], str]] = {
    "warehouse_reload_reviews_category_score": (
        reviews.rev_category_score, (*CATEGORY_TABLES, "order_reviews"), "order_reviews"
    ),
    "warehouse_reload_prices_core_kpis": (business.biz_core_kpis, KPI_TABLES, "order_items"),
}
MERGED: dict[str, tuple[Plan, tuple[str, ...]]] = {
    "warehouse_merge_core_kpis": (business.biz_core_kpis, KPI_TABLES),
    "warehouse_merge_payment_vs_score": (
        reviews.rev_payment_vs_score, (*SALES_TABLES, "order_payments", "order_reviews")
    ),
}
LAYERS_CORRECTED: dict[str, tuple[Plan, str, str]] = {
    "layer_refresh_prices_metric_sales_by_category": (
        partial(metrics.metric_table, measures=SALES, dims=["category"]),
        lattice.grain(["category"], people=True).name,
        "order_items",
    ),
    "layer_refresh_reviews_metric_service_by_state": (
        partial(metrics.service_table, measures=SERVICE, dims=["state"]),
        lattice.grain(["state"]).name,
        "order_reviews",
    ),
    "layer_refresh_prices_monthly_trend": (business.biz_monthly_trend, "month_summary", "order_items"),
    "layer_refresh_reviews_monthly_service": (layers.monthly_service, "month_summary", "order_reviews"),
    "layer_refresh_categories_rank": (products.prod_category_rank, "category_months", "products"),
}
# One layer is refreshed alone; the other is stale until it is refreshed too.
PARTLY_REFRESHED: dict[str, tuple[Plan, str, str]] = {
    "layer_refresh_partial_monthly_trend": (business.biz_monthly_trend, "seller_months", "month_summary"),
    "layer_refresh_partial_seller_tiers": (sellers.seller_tiers, "month_summary", "seller_months"),
}

# Reports from order tables stored in buckets.
BUCKETED: dict[str, tuple[Plan, tuple[str, ...]]] = {
    "bucketed_core_kpis": (business.biz_core_kpis, KPI_TABLES),
    "bucketed_order_value": (lambda t: _plain(GRAINS["grain_order_value"](t)), SALES_TABLES),
    "bucketed_payment_vs_score": (
        reviews.rev_payment_vs_score, ("orders", "order_payments", "order_reviews")
    ),
}

# Checks over tables that break their rules.
DIRTY: dict[str, Plan] = {
    "dq_orphan_orders_dirty": quality.dq_orphan_orders,
    "dq_price_anomalies_dirty": quality.dq_price_anomalies,
    "check_foreign_keys_dirty": checks.foreign_key_check,
    "check_not_null_dirty": checks.not_null_check,
    "check_domains_dirty": checks.domain_check,
}

# Reports answered from one stored layer.
FROM_LAYERS: dict[str, tuple[Plan, str]] = {
    "layer_monthly_trend": (business.biz_monthly_trend, "month_summary"),
    "layer_monthly_service": (layers.monthly_service, "month_summary"),
    "layer_core_kpis": (business.biz_core_kpis, "month_summary"),
    "layer_seller_tiers": (sellers.seller_tiers, "seller_months"),
    "layer_seller_concentration": (sellers.seller_concentration, "seller_months"),
    "layer_category_rank": (products.prod_category_rank, "category_months"),
    "layer_top_products": (products.prod_top_per_category, "product_months"),
    "layer_repeat_rate": (customers.cust_repeat_rate, "person_months"),
    "layer_frequency": (customers.cust_frequency, "person_months"),
    "layer_new_by_month": (customers.cust_new_by_month, "person_months"),
    "layer_cohort_retention": (customers.cust_cohort_retention, "person_months"),
    "layer_active_by_month": (derived.active_by_month, "person_months"),
    "layer_metric_sales_by_month": (
        partial(metrics.metric_table, measures=SALES, dims=["ym"]), "person_months"
    ),
}

# Measures answered from stored grains, from the smallest that can where there are two.
FROM_GRAINS: dict[str, tuple[Plan, tuple[str, ...]]] = {
    "layer_metric_sales_by_state": (
        partial(metrics.metric_table, measures=SALES, dims=["state"]),
        (lattice.grain(["state"], people=True).name,),
    ),
    "layer_metric_sales_by_category": (
        partial(metrics.metric_table, measures=SALES, dims=["category"]),
        (lattice.grain(["category"]).name, lattice.grain(["category"], people=True).name),
    ),
    "layer_metric_sales_by_seller_state_month": (
        partial(metrics.metric_table, measures=SALES, dims=["seller_state", "ym"]),
        (lattice.grain(["seller_state"], people=True).name,),
    ),
    "layer_metric_sales_filtered": (
        lambda t: metrics.metric_table(t, SALES, ["ym"], {"state": F.col("state") == "NATION_3"}),
        (lattice.grain(["state"], people=True).name,),
    ),
    "layer_metric_service_by_state": (
        partial(metrics.service_table, measures=SERVICE, dims=["state"]),
        (lattice.grain(["state"]).name,),
    ),
    "layer_metric_service_by_category": (
        partial(metrics.service_table, measures=SERVICE, dims=["category"]),
        (lattice.grain(["category"]).name,),
    ),
    "layer_metric_all_by_seller_state": (
        partial(metrics.measure_table, measures=SALES + SERVICE, dims=["seller_state"]),
        (lattice.grain(["seller_state"]).name, lattice.grain(["seller_state"], people=True).name),
    ),
}


def _plain(df: DataFrame) -> DataFrame:
    """Types every client reads alike: times as text, amounts and ratios as double."""

    def plain(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            column = clock_text(column)
        elif isinstance(field.dataType, T.DecimalType) or field.name == "review_score":
            column = column.cast("double")
        elif isinstance(field.dataType, T.IntegerType):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def _cleaned(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(cleaning.CLEANERS[name](raw_tables(spark, sf_dir)[name]))


def _new_folder(spark: SparkSession) -> str:
    return f"{own_folder(spark)}/{uuid.uuid4().hex}"


def _from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files out, read back raw, cleaned, stored and reported."""
    folder = _new_folder(spark)
    for name, raw in raw_tables(spark, sf_dir).items():
        target = raw_csv.FILE_PATTERNS[name].replace("*", "shop")
        raw.write.options(**CSV).csv(f"{folder}/raw/{target}")
    raw_csv.clean_all(spark, f"{folder}/raw", f"{folder}/clean")
    return business.biz_monthly_trend(warehouse.read_clean(spark, f"{folder}/clean").tables)


def _review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose messages hold quotes and line breaks, written and read back in byte ranges."""
    folder = _new_folder(spark)
    message = F.concat(
        F.lit('line one, "'), F.col("order_id"), F.lit('"\n\nline three "'), F.col("review_score"), F.lit('"')
    )
    reviews = raw_tables(spark, sf_dir)["order_reviews"].withColumn("review_comment_message", message)
    target = raw_csv.FILE_PATTERNS["order_reviews"].replace("*", "shop")
    reviews.write.options(**CSV).csv(f"{folder}/{target}")
    text = F.col("review_comment_message")
    return (
        raw_csv.read_raw(spark, folder, "order_reviews")
        .groupBy(F.col("review_score").cast("bigint").alias("review_score"))
        .agg(
            F.count("*").alias("records"),
            F.sum(F.length(text)).alias("message_chars"),
            F.count_if(text.endswith(F.concat(F.lit('\n\nline three "'), F.col("review_score"), F.lit('"'))))
            .alias("whole_messages"),
        )
    )


def _from_warehouse(
    plan: Plan, names: tuple[str, ...], spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    warehouse.load_warehouse(Tables(**{name: t[name] for name in names}), folder)
    return plan(warehouse.read_warehouse(spark, folder))


def _from_layers(
    plan: Plan, names: tuple[str, ...], spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    layers.refresh_layers(t, folder, names=names)
    return plan(layers.attach_layers(t, spark, folder, names=names))


def _changed(t: Tables) -> Tables:
    """January 1995 is gone and every tenth order was bought 45 days later."""
    bought, month = F.col("order_purchase_timestamp"), _purchase_month()
    later = F.when(F.col("order_id") % 10 == 4, bought + F.expr("INTERVAL 45 DAYS")).otherwise(bought)
    kept = t["orders"].filter(month != "1995-01")
    return t.replaced(orders=kept.withColumn("order_purchase_timestamp", later))


def _reloaded(
    plan: Plan, names: tuple[str, ...], by_month: bool, spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    before = Tables(**{name: t[name] for name in names})
    warehouse.load_warehouse(before, folder)
    now = _changed(before)
    months = warehouse.months_to_load(now, folder) if by_month else None
    warehouse.load_warehouse(now, folder, months)
    return plan(warehouse.read_warehouse(spark, folder))


def _refreshed(
    plan: Plan, names: tuple[str, ...], spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    layers.refresh_layers(t, folder, names=names)
    now = _changed(t)
    marks = layers.layer_marks(now, names)
    months = layers.stale_months(now, spark, folder, marks=marks)
    layers.refresh_layers(now, folder, months, names, marks)
    return plan(layers.attach_layers(now, spark, folder, names=names))


def _uncorrected(t: Tables, table: str) -> Tables:
    """The tables as they were before late reviews came, prices or categories were corrected."""
    rows = t[table]
    if table == "order_reviews":
        return t.replaced(order_reviews=rows.filter(F.col("order_id") % 5 != 3))
    if table == "order_items":
        wrong = (F.col("price") + 1).cast(rows.schema["price"].dataType)
        price = F.when(F.col("order_id") % 7 == 2, wrong).otherwise(F.col("price"))
        return t.replaced(order_items=rows.withColumn("price", price))
    name = F.col("product_category_name")
    moved = F.when(F.col("product_id") % 6 == 1, F.lit("Brand#1")).otherwise(name)
    return t.replaced(products=rows.withColumn("product_category_name", moved))


def _corrected(
    plan: Plan, names: tuple[str, ...], table: str, spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    now = Tables(**{name: t[name] for name in names})
    warehouse.load_warehouse(_uncorrected(now, table), folder)
    warehouse.load_warehouse(now, folder, warehouse.months_to_load(now, folder))
    return plan(warehouse.read_warehouse(spark, folder))


def _merged(plan: Plan, names: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some orders are missing at first and others have wrong times; both come as a delta."""
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    now = Tables(**{name: t[name] for name in names})
    of_order = [name for name in names if "order_id" in now[name].columns]
    key = F.col("order_id")
    early = F.when(key % 11 == 4, F.col("order_purchase_timestamp") - F.expr("INTERVAL 40 DAYS"))
    first = {name: now[name].filter(key % 11 != 7) for name in of_order}
    first["orders"] = first["orders"].withColumn(
        "order_purchase_timestamp", F.coalesce(early, "order_purchase_timestamp")
    )
    warehouse.load_warehouse(now.replaced(**first), folder)
    delta = {name: now[name].filter((key % 11).isin(4, 7)) for name in of_order}
    warehouse.merge_orders(Tables(**delta), folder)
    return plan(warehouse.read_warehouse(spark, folder))


def _layers_corrected(
    plan: Plan, layer: str, table: str, spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    layers.refresh_layers(_uncorrected(t, table), folder, names=[layer])
    marks = layers.layer_marks(t, [layer])
    months = layers.stale_months(t, spark, folder, [layer], marks)
    layers.refresh_layers(t, folder, months, [layer], marks)
    return plan(layers.attach_layers(t, spark, folder, names=[layer]))


def _partly_refreshed(
    plan: Plan, first: str, second: str, spark: SparkSession, sf_dir: str
) -> DataFrame:
    folder, t, names = _new_folder(spark), role_tables(spark, sf_dir), [first, second]
    layers.refresh_layers(t, folder, names=names)
    now = _changed(t)
    marks = layers.layer_marks(now, names)
    for name in names:
        months = layers.stale_months(now, spark, folder, [name], marks)
        layers.refresh_layers(now, folder, months, [name], marks)
    return plan(layers.attach_layers(now, spark, folder, names=names))


def _bucketed(plan: Plan, names: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, t = _new_folder(spark), role_tables(spark, sf_dir)
    database = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucketed.load_bucketed(Tables(**{name: t[name] for name in names}), database, buckets)
    return plan(bucketed.read_bucketed(spark, database))


def _dirty(t: Tables) -> Tables:
    """Orphans, NULL keys, negative amounts and scores out of range."""
    key = F.col("order_id")

    def unless(rest: int, modulus: int, column: str):
        return F.when(key % modulus != rest, F.col(column))

    def negative(rest: int, modulus: int, column: str):
        return F.when(key % modulus == rest, -F.col(column)).otherwise(F.col(column))

    freight = F.when(key % 17 == 1, F.lit(-1).cast("decimal(12,2)")).otherwise(F.col("freight_value"))
    score = F.when(key % 7 == 6, 9).otherwise(F.col("review_score"))
    return t.replaced(
        customers=t["customers"].filter(F.col("customer_id") % 11 != 5),
        orders=t["orders"].withColumn("customer_id", unless(7, 23, "customer_id")).filter(key % 29 != 8),
        order_items=t["order_items"].withColumns(
            {"price": negative(2, 13, "price"), "order_item_id": unless(3, 19, "order_item_id"),
             "freight_value": freight}
        ),
        order_payments=t["order_payments"].withColumn(
            "payment_value", negative(4, 31, "payment_value")
        ),
        order_reviews=t["order_reviews"].withColumn("review_score", score),
    )


def _over_roles(plan: Plan, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(role_tables(spark, sf_dir))


def registered_queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        name: partial(_over_roles, plan) for name, plan in (PLANS | VARIANTS).items()
    }
    found |= {
        name: partial(_over_roles, lambda t, plan=plan: _plain(plan(t)))
        for name, plan in GRAINS.items()
    }
    found |= {f"clean_{name}": partial(_cleaned, name) for name in cleaning.CLEANERS}
    found["eda_review_duplicates"] = lambda spark, sf_dir: profiling.review_duplicates(
        raw_tables(spark, sf_dir)["order_reviews"]
    )
    found["csv_monthly_trend"] = _from_csv
    found["csv_review_records"] = _review_records
    found |= {
        name: partial(_from_warehouse, plan, needed)
        for name, (plan, needed) in FROM_WAREHOUSE.items()
    }
    found |= {
        name: partial(_from_layers, plan, (layer,)) for name, (plan, layer) in FROM_LAYERS.items()
    }
    found |= {name: partial(_from_layers, *how) for name, how in FROM_GRAINS.items()}
    found |= {name: partial(_reloaded, *how) for name, how in RELOADED.items()}
    found |= {name: partial(_refreshed, *how) for name, how in REFRESHED.items()}
    found |= {name: partial(_corrected, *how) for name, how in CORRECTED.items()}
    found |= {name: partial(_merged, *how) for name, how in MERGED.items()}
    found |= {name: partial(_layers_corrected, *how) for name, how in LAYERS_CORRECTED.items()}
    found |= {name: partial(_partly_refreshed, *how) for name, how in PARTLY_REFRESHED.items()}
    found |= {name: partial(_bucketed, *how) for name, how in BUCKETED.items()}
    found |= {
        name: partial(_over_roles, lambda t, plan=plan: plan(_dirty(t)))
        for name, plan in DIRTY.items()
    }
    return found
