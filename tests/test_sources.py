"""Raw files to cleaned tables to a monthly warehouse and its summary layers."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.__main__ import main
from stallworks.operators.cleaning import CLEANERS, clean_order_reviews
from stallworks.plans import business, derived, layers, pages, products, reviews, sellers
from stallworks.plans.business import biz_core_kpis, biz_monthly_trend
from stallworks.sources import warehouse
from stallworks.sources.raw_csv import clean_all, read_raw
from stallworks.sources.roles import role_tables
from stallworks.sources.schemas import MONTH, SCHEMAS, TABLE_NAMES
from tests.compare import spark_rows
from tests.shop import rows

FILES = {
    "shop_customers_dataset.csv": '''"customer_id","customer_unique_id","customer_zip_code_prefix","customer_city","customer_state"
"c1","ann","01409","sao paulo","SP"
"c2","bob","13023","campinas","SP"
''',
    "shop_orders_dataset.csv": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2017-10-15 00:30:00,2017-10-15 11:07:15,,2017-10-20 21:25:13,2017-10-28 00:00:00
o2,c2,canceled,2017-11-02 10:00:00,not a date,,,2017-11-20 00:00:00
""",
    "shop_order_items_dataset.csv": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,p1,s1,2017-10-18 11:07:15,29.99,8.72
o1,2,p2,s1,2017-10-18 11:07:15,0.10,8.72
""",
    "shop_order_payments_dataset.csv": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,1,credit_card,8,47.53
""",
    "shop_order_reviews_dataset.csv": '''"review_id","order_id","review_score","review_comment_title","review_comment_message","review_creation_date","review_answer_timestamp"
"r2","o1","4",,"first, with ""quotes"" and
a second line","2018-01-18 00:00:00","2018-01-18 21:46:59"
"r1","o2","1",,,"2018-03-10 00:00:00","2018-03-11 03:05:13"
"r2","o2","5",,"later row, earlier date","2018-01-01 00:00:00","2018-01-02 21:46:59"
''',
    "shop_products_dataset.csv": """product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
p1,perfumaria,40,287,1,225,16,10,14
p2,NA,,,,,,,
""",
    "shop_sellers_dataset.csv": """seller_id,seller_zip_code_prefix,seller_city,seller_state
s1,04195,"sao paulo, sp",SP
""",
    # The published translation file starts with a byte order mark.
    "product_category_name_translation.csv": """﻿product_category_name,product_category_name_english
perfumaria,perfumery
""",
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def clean(spark, raw, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("clean"))
    return folder, rows(clean_all(spark, raw, folder))


def test_clean_all_writes_every_table_typed(spark, clean):
    folder, report = clean
    assert {r["tbl"]: r["rows_cnt"] for r in report} == {
        "category_name": 1, "sellers": 1, "products": 2, "customers": 2,
        "orders": 2, "order_items": 2, "order_payments": 1, "order_reviews": 2,
    }
    loaded = warehouse.read_clean(spark, folder)
    assert loaded.missing == ()
    t = loaded.tables
    for name in TABLE_NAMES:
        assert [(f.name, f.dataType) for f in t[name].schema] == [
            (f.name, f.dataType) for f in SCHEMAS[name].fields
        ]
    orders = {r["order_id"]: r for r in rows(t["orders"])}
    assert orders["o1"]["order_purchase_timestamp"] == datetime(2017, 10, 15, 0, 30)
    assert orders["o2"]["order_approved_at"] is None  # unreadable
    assert orders["o1"]["order_delivered_carrier_date"] is None  # empty
    assert rows(t["customers"].orderBy("customer_id"))[0]["customer_zip_code_prefix"] == 1409
    assert {r["product_category_name"] for r in rows(t["products"])} == {"perfumaria", "unknown"}
    assert rows(t["order_items"].orderBy("order_item_id"))[0]["price"] == Decimal("29.99")
    assert rows(t["category_name"]) == [
        {"product_category_name": "perfumaria", "product_category_name_english": "perfumery"}
    ]
    assert rows(biz_core_kpis(t))[0]["gmv"] == 30.09


def test_first_review_in_the_file_is_kept(spark, raw, clean):
    kept = {r["review_id"]: r for r in rows(warehouse.read_clean(spark, clean[0]).tables["order_reviews"])}
    assert kept["r2"]["order_id"] == "o1" and kept["r2"]["review_score"] == 4
    assert kept["r2"]["review_comment_message"] == 'first, with "quotes" and\na second line'
    # Without file places the earliest creation decides.
    unplaced = read_raw(spark, raw, "order_reviews").drop("_file", "_block", "_row")
    earliest = {r["review_id"]: r for r in rows(clean_order_reviews(unplaced))}
    assert earliest["r2"]["order_id"] == "o2"


def test_places_follow_files_in_order(spark, tmp_path):
    head = FILES["shop_order_reviews_dataset.csv"].split("\n", 1)[0]
    for part in range(4):
        lines = [f"r{i},o{part}-{i},3,,,2018-01-01 00:00:00,2018-01-02 00:00:00" for i in range(50)]
        (tmp_path / f"part{part}_order_reviews_dataset.csv").write_text(
            head.replace('"', "") + "\n" + "\n".join(lines) + "\n"
        )
    kept = rows(clean_order_reviews(read_raw(spark, str(tmp_path), "order_reviews")))
    assert len(kept) == 50 and all(r["order_id"].startswith("o0-") for r in kept)


def test_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "x_sellers_dataset.csv").write_text("seller_id,city\ns1,a\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_raw(spark, str(tmp_path), "sellers").collect()


def test_unreadable_amount_stops_the_job(spark):
    bad = spark.createDataFrame(
        [("o1", "1", "p", "s", None, "12,50", "1")],
        T.StructType([T.StructField(n, T.StringType()) for n in SCHEMAS["order_items"].names]),
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        CLEANERS["order_items"](bad).collect()


def test_missing_tables_are_reported(spark, clean, tmp_path):
    source = warehouse.read_clean(spark, clean[0]).tables["orders"]
    source.write.parquet(str(tmp_path / "orders"))
    loaded = warehouse.read_clean(spark, str(tmp_path))
    assert loaded.tables.present() == ["orders"]
    assert set(loaded.missing) == set(TABLE_NAMES) - {"orders"}
    with pytest.raises(KeyError):
        loaded.tables["sellers"]


def test_csv_sink_round_trip(spark, raw, tmp_path):
    clean_all(spark, raw, str(tmp_path), fmt="csv").collect()
    t = warehouse.read_clean(spark, str(tmp_path), fmt="csv").tables
    assert rows(biz_core_kpis(t))[0]["gmv"] == 30.09
    assert t["order_reviews"].count() == 2


def test_single_cleaned_files_are_read(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
        "order_delivered_carrier_date,order_delivered_customer_date,"
        "order_estimated_delivery_date\n"
        "o1,c1,delivered,2017-10-15 00:30:00,,,2017-10-20 21:25:13,2017-10-28\n"
    )
    loaded = warehouse.read_clean(spark, str(tmp_path), fmt="csv")
    assert loaded.tables.present() == ["orders"]
    only = rows(loaded.tables["orders"])[0]
    assert only["order_purchase_timestamp"] == datetime(2017, 10, 15, 0, 30)
    assert only["order_approved_at"] is None
    assert only["order_estimated_delivery_date"] == datetime(2017, 10, 28)


def test_command_line(spark, raw, tmp_path, capsys):
    clean, stored, out = (str(tmp_path / n) for n in ("clean", "stored", "out"))
    main(["clean", raw, clean])
    main(["check", clean])
    main(["report", clean, "biz_core_kpis"])
    main(["report", clean, "biz_monthly_trend", "--out", out])
    main(["load", clean, stored])
    main(["list"])
    printed = capsys.readouterr().out
    assert "30.09" in printed and "order_items: " in printed and "cust_rfm" in printed
    assert rows(spark.read.parquet(out))[0]["ym"] == "2017-10"
    with pytest.raises(SystemExit):
        main(["report", clean, "no_such_report"])


def test_loading_twice_changes_nothing(spark, small_dir, tmp_path):
    t, folder = role_tables(spark, small_dir), str(tmp_path / "w")
    warehouse.load_warehouse(t, folder)
    warehouse.load_warehouse(t, folder)
    stored = warehouse.read_warehouse(spark, folder)
    for name in TABLE_NAMES:
        assert stored[name].count() == t[name].count(), name
    assert spark_rows(biz_monthly_trend(stored)) == spark_rows(biz_monthly_trend(t))
    pruned = stored["orders"].filter(F.col(MONTH) == "1996-03")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_ym" in plan


def test_months_are_gathered_and_split_by_a_rebalance(spark, small_dir):
    t = role_tables(spark, small_dir)
    plan = warehouse.with_extras(t, "orders").hint("rebalance", MONTH)
    assert "REBALANCE_PARTITIONS_BY_COL" in plan._jdf.queryExecution().executedPlan().toString()


def test_declared_tables(spark, raw, tmp_path):
    statements = warehouse.create_statements("shop")
    assert len(statements) == 8
    # Keys and references are declared as properties, parents before children.
    items = next(s for s in statements if "shop.order_items" in s)
    assert "'primary_key'='order_id,order_item_id'" in items
    assert "'references.seller_id'='sellers'" in items and "price decimal(12,2)" in items
    spark.sql(f"CREATE DATABASE IF NOT EXISTS declared LOCATION '{tmp_path}/declared'")
    warehouse.create_schema(spark, "declared")
    warehouse.create_schema(spark, "declared")
    found = {r.tableName for r in spark.sql("SHOW TABLES IN declared").collect() if not r.isTemporary}
    assert found == set(TABLE_NAMES)

    folder = str(tmp_path / "clean")
    clean_all(spark, raw, folder)
    t = warehouse.read_clean(spark, folder).tables
    for _ in range(2):
        warehouse.load_database(t, "declared")
    stored = warehouse.read_database(spark, "declared")
    assert {n: stored[n].count() for n in TABLE_NAMES} == {n: t[n].count() for n in TABLE_NAMES}
    assert rows(biz_core_kpis(stored))[0]["gmv"] == 30.09
    spark.sql("DROP DATABASE declared CASCADE")


@pytest.fixture(scope="module")
def monthly(spark, small_dir, tmp_path_factory):
    t, folder = role_tables(spark, small_dir), str(tmp_path_factory.mktemp("monthly"))
    warehouse.load_warehouse(t, folder)
    return t, warehouse.read_warehouse(spark, folder)


@pytest.mark.parametrize(
    "report",
    [
        business.biz_category_structure, products.prod_category_score,
        products.prod_top_per_category, sellers.seller_concentration,
        sellers.seller_order_bands, derived.category_new_buyers, derived.seller_health,
        reviews.rev_category_score, pages.category_scatter, sellers.seller_quality_risk,
    ],
)
def test_stored_items_need_no_order_join(monthly, report):
    t, stored = monthly
    assert spark_rows(report(stored)) == spark_rows(report(t))
    plan = report(stored)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_status,delivered)" in plan


@pytest.fixture(scope="module")
def layered(spark, small_dir, tmp_path_factory):
    t, folder = role_tables(spark, small_dir), str(tmp_path_factory.mktemp("layers"))
    layers.refresh_layers(t, folder)
    return t, layers.attach_layers(t, spark, folder)


@pytest.mark.parametrize(
    "report",
    [
        business.biz_core_kpis, business.biz_monthly_trend, business.biz_monthly_mom,
        business.biz_category_structure, products.prod_category_rank,
        products.prod_category_concentration, products.prod_freight_sensitivity,
        products.prod_top_per_category, sellers.seller_concentration, sellers.seller_tiers,
        sellers.seller_order_bands, sellers.seller_ranking, derived.tier_by_cum_share,
        derived.monthly_yoy, derived.freight_ratio, pages.category_scatter,
    ],
)
def test_layers_give_the_same_reports_without_reading_items(layered, report):
    t, stored = layered
    assert spark_rows(report(stored)) == spark_rows(report(t))
    plan = report(stored)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "l_extendedprice" not in plan


def _summary(t, spark, folder):
    return layers.attach_layers(t, spark, folder, verify=False).layer("month_summary")


def test_layers_refresh_only_the_named_months(spark, small_dir, tmp_path):
    t, folder = role_tables(spark, small_dir), str(tmp_path / "layers")
    names = ["month_summary"]
    layers.refresh_layers(t, folder, names=names)
    before = spark_rows(_summary(t, spark, folder))
    layers.refresh_layers(t, folder, months=["1996-03", "1996-04"], names=names)
    assert spark_rows(_summary(t, spark, folder)) == before

    # A corrected month replaces itself and leaves the others alone.
    march = F.date_format("order_purchase_timestamp", "yyyy-MM") == "1996-03"
    corrected = t.replaced(
        orders=t["orders"].withColumn(
            "order_status", F.when(march, "canceled").otherwise(F.col("order_status"))
        )
    )
    layers.refresh_layers(corrected, folder, months=["1996-03"], names=names)
    summary = _summary(t, spark, folder)
    assert [r["order_status"] for r in rows(summary.filter("purchase_ym = '1996-03'"))] == [
        "canceled"
    ]
    assert len(spark_rows(summary.filter("purchase_ym <> '1996-03'"))[1]) == len(before[1]) - 3
    trend = {r["ym"] for r in rows(biz_monthly_trend(t.with_layers(month_summary=summary)))}
    assert "1996-03" not in trend and "1996-04" in trend


def test_layers_from_the_monthly_warehouse_prune_partitions(spark, small_dir, tmp_path):
    t, folder = role_tables(spark, small_dir), str(tmp_path / "l")
    warehouse.load_warehouse(t, str(tmp_path / "w"))
    stored = warehouse.read_warehouse(spark, str(tmp_path / "w"))
    layers.refresh_layers(stored, folder, months=["1996-03"])
    month = next(r for r in rows(biz_monthly_trend(t)) if r["ym"] == "1996-03")
    only = rows(biz_monthly_trend(layers.attach_layers(t, spark, folder, verify=False)))
    assert [(r["ym"], r["gmv"], r["orders"]) for r in only] == [
        ("1996-03", month["gmv"], month["orders"])
    ]
