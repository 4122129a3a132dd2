"""Changes of any table are noticed month by month, merged order by order, and joins need no shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stallworks.plans import business, customers, derived, layers, metrics, products, reviews
from stallworks.operators import grain
from stallworks.sources import bucketed, warehouse
from stallworks.sources.fingerprints import different_months, fingerprints
from stallworks.sources.roles import role_tables
from stallworks.sources.schemas import MONTH
from stallworks.sources.tables import Tables
from tests.compare import spark_rows
from tests.shop import customer, item, order, product, review, rows, shop


def three_months(spark, price=10, late_review=False, category="toys"):
    """One order in each of three months; what changes is in February."""
    days = {"a": "1995-01-05", "b": "1995-02-06", "c": "1995-03-07"}
    return shop(
        spark,
        orders=[order(k, d, arrived=d, promised=d) for k, d in days.items()],
        customers=[customer(f"c-{k}", "p" if k != "c" else "q") for k in days],
        order_items=[item(k, 1, price if k == "b" else 7, product=f"x{k}") for k in days],
        order_reviews=[review("r1", "a", 4)] + [review("r2", "b", 1)] * late_review,
        products=[product("xa", "toys"), product("xb", category), product("xc", "toys")],
    )


def parts_of(name):
    return layers.LAYER_PARTS[name]


@pytest.mark.parametrize(
    "change, touched",
    [
        ({"price": 11}, {"order_facts", "month_summary", "seller_months", "category_months",
                         "product_months", "person_months"}),
        ({"late_review": True}, {"order_facts", "month_summary"}),
        ({"category": "books"}, {"category_months"}),
    ],
)
def test_a_change_makes_its_month_stale_in_the_layers_it_touches(spark, tmp_path, change, touched):
    folder, now = str(tmp_path), three_months(spark, **change)
    layers.refresh_layers(three_months(spark), folder)
    stale = layers.stale_layers(now, spark, folder)
    assert stale == {name: ["1995-02"] if name in touched else [] for name in layers.LAYERS}
    with pytest.raises(ValueError, match="stale"):
        layers.attach_layers(now, spark, folder)
    first = sorted(touched)[0]
    layers.refresh_layers(now, folder, ["1995-02"], [first])
    stale = layers.stale_layers(now, spark, folder)
    assert {name for name, months in stale.items() if months} == touched - {first}
    layers.refresh_layers(now, folder, ["1995-02"])
    attached = layers.attach_layers(now, spark, folder)
    for report in (business.biz_monthly_trend, products.prod_category_rank, layers.monthly_service):
        plain = now.with_layers(month_summary=layers.month_summary(now))
        assert spark_rows(report(attached)) == spark_rows(report(plain))


@pytest.mark.parametrize("change", [{"price": 11}, {"late_review": True}])
def test_a_change_is_loaded_with_its_month_only(spark, tmp_path, change):
    folder, now = str(tmp_path), three_months(spark, **change)
    warehouse.load_warehouse(three_months(spark), folder)
    assert warehouse.months_to_load(three_months(spark), folder) == []
    assert warehouse.months_to_load(now, folder) == ["1995-02"]
    warehouse.load_warehouse(now, folder, ["1995-02"])
    assert warehouse.months_to_load(now, folder) == []


def test_fingerprints_tell_where_a_null_is_and_count_repeats(spark):
    def mark(price, freight, times=1):
        columns = "order_id string, price double, freight_value double"
        items = spark.createDataFrame([("a", price, freight)] * times, columns)
        t = three_months(spark).replaced(order_items=items)
        parts = {"values": ("order_items", ("order_id", "price", "freight_value"))}
        return fingerprints(t, parts)

    assert different_months(mark(1.0, None), mark(None, 1.0)) == ["1995-01"]
    assert different_months(mark(1.0, 2.0), mark(1.0, 2.0, times=2)) == ["1995-01"]
    assert different_months(mark(1.0, 2.0), mark(1.0, 2.0)) == []


def test_a_merge_replaces_single_orders(spark, tmp_path):
    folder = str(tmp_path)
    warehouse.load_warehouse(three_months(spark), folder)
    march = set((tmp_path / "orders" / f"{MONTH}=1995-03").iterdir())
    delta = shop(
        spark,
        orders=[order("b", "1995-01-20"), order("d", "1995-02-01")],
        customers=[customer("c-b", "z"), customer("c-d", "p")],
        order_items=[item("b", 1, 99), item("d", 1, 5), item("d", 2, 6)],
        order_reviews=[review("r9", "d", 5)],
    )
    gone = spark.createDataFrame([("a",)], "order_id string")
    assert warehouse.merge_orders(delta, folder, gone) == ["1995-01", "1995-02"]
    stored = warehouse.read_warehouse(spark, folder)
    keys = {(r.order_id, r[MONTH]) for r in stored["orders"].collect()}
    assert keys == {("b", "1995-01"), ("c", "1995-03"), ("d", "1995-02")}
    prices = sorted((r.order_id, float(r.price)) for r in stored["order_items"].collect())
    assert prices == [("b", 99.0), ("c", 7.0), ("d", 5.0), ("d", 6.0)]
    assert [r.review_id for r in stored["order_reviews"].collect()] == ["r9"]
    people = {r.customer_id: r.customer_unique_id for r in stored["customers"].collect()}
    assert people == {"c-a": "p", "c-b": "z", "c-c": "q", "c-d": "p"}
    assert set((tmp_path / "orders" / f"{MONTH}=1995-03").iterdir()) == march
    assert warehouse.merge_orders(shop(spark), folder) == []


def test_a_merge_stages_the_delta_and_moves_stored_rows_once(spark, tmp_path, monkeypatch, no_broadcast):
    folder, days = str(tmp_path), range(10, 28)
    first = shop(
        spark,
        orders=[order(f"o{d}", f"1995-01-{d}") for d in days],
        order_items=[item(f"o{d}", n, 7) for d in days for n in (1, 2)],
        order_reviews=[review(f"r{d}", f"o{d}", 4) for d in days],
    )
    warehouse.load_warehouse(first, folder)
    staged, plans, real, replace = [], {}, warehouse.written, warehouse.replace_months

    def staging(rows):
        made = real(rows)
        staged.append(made.count())
        return made

    def replacing(rows, path, *how, **more):
        plans[path.rsplit("/", 1)[1]] = plan_of(rows)
        return replace(rows, path, *how, **more)

    monkeypatch.setattr(warehouse, "written", staging)
    monkeypatch.setattr(warehouse, "replace_months", replacing)
    delta = shop(spark, orders=[order("o12", "1995-01-30")], order_items=[item("o12", 1, 9)])
    assert warehouse.merge_orders(delta, folder) == ["1995-01"]
    assert max(staged) <= 1
    assert list(plans)[-1] == "orders"
    assert all("REPARTITION_BY_COL" in p and "LeftAnti" not in p for p in plans.values())
    stored = warehouse.read_warehouse(spark, folder)
    assert sorted(r.order_id for r in stored["orders"].collect()) == [f"o{d}" for d in days]
    assert stored["order_items"].count() == 2 * len(days) - 1
    assert {r.review_id for r in stored["order_reviews"].collect()} == {f"r{d}" for d in days if d != 12}


def test_a_merge_of_rows_read_from_the_warehouse_itself(spark, tmp_path):
    folder = str(tmp_path)
    first = shop(
        spark,
        orders=[order("a", "1995-01-05"), order("a", "1995-02-05"), order("b", "1995-02-06"), order(None, "1995-02-07")],
        order_items=[item("a", 1, 5), item("b", 1, 7), item(None, 1, 8), item("lost", 1, 9)],
        order_reviews=[review("r1", "b", 4), review("r1", "b", 4), review("r2", None, 3)],
    )
    warehouse.load_warehouse(first, folder)
    stored = warehouse.read_warehouse(spark, folder)
    mine = F.col("order_id") == "b"
    later = F.col("order_purchase_timestamp") + F.expr("INTERVAL 31 DAYS")
    delta = {name: stored[name].filter(mine) for name in ("order_items", "order_reviews")}
    delta["orders"] = stored["orders"].filter(mine).withColumn("order_purchase_timestamp", later)
    gone = spark.createDataFrame([("a",), (None,)], "order_id string")
    months = warehouse.merge_orders(Tables(**delta), folder, gone)
    assert months == ["1995-01", "1995-02", "1995-03"]
    stored = warehouse.read_warehouse(spark, folder)
    found = {name: sorted(((r.order_id, r[MONTH]) for r in stored[name].collect()), key=str)
             for name in ("orders", "order_items", "order_reviews")}
    assert found["orders"] == [("b", "1995-03"), (None, "1995-02")]
    assert found["order_items"] == [("b", "1995-03"), ("lost", None), (None, None)]
    assert found["order_reviews"] == [("b", "1995-03"), ("b", "1995-03"), (None, None)]


def test_database_months_take_one_insert_per_table(spark, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE once LOCATION '{tmp_path}/once'")
    warehouse.create_schema(spark, "once")
    warehouse.load_database(three_months(spark), "once")
    inserted, real = [], warehouse._insert_months
    monkeypatch.setattr(warehouse, "_insert_months", lambda *a: inserted.append(a[1]) or real(*a))
    now = three_months(spark, price=12)
    warehouse.load_database(now, "once", ["1995-02", "1995-03", "1995-07"])
    assert inserted == [f"once.{n}" for n in ("orders", "order_items", "order_payments", "order_reviews")]
    found = warehouse.read_database(spark, "once")
    assert spark_rows(business.biz_monthly_trend(found)) == spark_rows(business.biz_monthly_trend(now))
    spark.sql("DROP DATABASE once CASCADE")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_order_joins_of_bucketed_tables_need_no_exchange(spark, small_dir, tmp_path, no_broadcast):
    spark.sql(f"CREATE DATABASE in_buckets LOCATION '{tmp_path}/b'")
    t = role_tables(spark, small_dir)
    in_buckets = bucketed.load_bucketed(t, "in_buckets", 4)
    assert all(in_buckets[name] for name in bucketed.BY_ORDER)
    stored = bucketed.read_bucketed(spark, "in_buckets")
    for report in (business.biz_core_kpis, grain.valid_order_value, reviews.rev_payment_vs_score):
        assert "hashpartitioning(order_id" in plan_of(report(t))
        assert "hashpartitioning(order_id" not in plan_of(report(stored))
        assert spark_rows(report(stored)) == spark_rows(report(t))
    spark.sql("DROP DATABASE in_buckets CASCADE")


def test_a_table_with_a_hot_order_is_not_stored_in_buckets(spark, hot_dir, tmp_path):
    spark.sql(f"CREATE DATABASE hot_order LOCATION '{tmp_path}/h'")
    t = role_tables(spark, hot_dir)
    in_buckets = bucketed.load_bucketed(t, "hot_order", 16)
    assert in_buckets["orders"] and not in_buckets["order_items"]
    stored = bucketed.read_bucketed(spark, "hot_order")
    assert spark_rows(business.biz_core_kpis(stored)) == spark_rows(business.biz_core_kpis(t))
    assert not bucketed.has_hot_order(t["orders"].limit(0), 16)
    spark.sql("DROP DATABASE hot_order CASCADE")


def test_person_reports_from_stored_months_read_no_order(spark, small_dir, tmp_path):
    t = role_tables(spark, small_dir)
    layers.refresh_layers(t, str(tmp_path), names=["person_months"])
    attached = layers.attach_layers(t, spark, str(tmp_path), ["person_months"])
    march = {"ym": F.col("ym") == F.lit("1996-03-01").cast("date")}
    everything = list(metrics.SALES_MEASURES)
    served = [
        customers.cust_repeat_rate, customers.cust_frequency, customers.cust_new_by_month,
        customers.cust_cohort_retention, derived.active_by_month,
        lambda t: metrics.metric_table(t, everything),
        lambda t: metrics.metric_table(t, everything, ["ym"]),
        lambda t: metrics.metric_table(t, everything, [], march),
    ]
    for report in served:
        plan = plan_of(report(attached))
        assert "o_orderkey" not in plan and "l_orderkey" not in plan
        assert spark_rows(report(attached)) == spark_rows(report(t))
    assert MONTH in plan_of(served[-1](attached)).split("PartitionFilters: ")[1].split("]")[0]
    # A person's state is not among the stored columns, so orders are read.
    by_state = metrics.metric_table(attached, ["buyers"], ["state"])
    assert "o_orderkey" in plan_of(by_state)
    assert spark_rows(by_state) == spark_rows(metrics.metric_table(t, ["buyers"], ["state"]))


def test_person_months_without_a_purchase_time(spark, tmp_path):
    t = shop(
        spark,
        orders=[order("a", None), order("b", "1995-01-05"), order("c", None)],
        customers=[customer("c-a", "p"), customer("c-b", "p"), customer("c-c", "q")],
        order_items=[item("a", 1, 3)],
    )
    layers.refresh_layers(t, str(tmp_path), names=["person_months"])
    attached = layers.attach_layers(t, spark, str(tmp_path), ["person_months"])
    for report in (customers.cust_repeat_rate, customers.cust_new_by_month, derived.active_by_month):
        assert rows(report(attached)) == rows(report(t))
