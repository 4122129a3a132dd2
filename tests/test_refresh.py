"""Stored tables after rows have gone or moved, and plans that prune what is stored."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallworks.operators.ranking import remove_written, shared_folder, written
from stallworks.plans import business, customers, derived, layers, logistics, metrics, pages
from stallworks.registry import _changed
from stallworks.sources import warehouse
from stallworks.sources.roles import role_tables
from stallworks.sources.schemas import MONTH
from tests.compare import spark_rows
from tests.shop import customer, item, order, review, rows, shop

REPORTS = (business.biz_monthly_trend, business.biz_core_kpis, logistics.log_seller)


def january_and_march(spark, moved=False, removed=False):
    """Two months, an order without a month, and what each holds."""
    orders = [order("a", "1995-01-05", arrived="1995-01-09", promised="1995-01-08")] * (not removed)
    orders += [order("b", "1995-03-20" if moved else "1995-01-20"), order("c", "1995-03-01")]
    orders += [order("d", None)] * (not removed)
    keys = [o["order_id"] for o in orders]
    return shop(
        spark,
        orders=orders,
        customers=[customer(f"c-{k}", k) for k in keys],
        order_items=[item(k, 1, 10 * (i + 1)) for i, k in enumerate(keys)],
        order_reviews=[review(f"r{k}", k, 4) for k in keys],
    )


def figures(t):
    sums = t["order_items"].agg(F.sum("price"), F.count("*")).first()
    return float(sums[0]), sums[1], t["orders"].count(), t["order_reviews"].count()


def test_full_reload_drops_what_is_gone(spark, tmp_path):
    folder = str(tmp_path)
    warehouse.load_warehouse(january_and_march(spark), folder)
    now = january_and_march(spark, moved=True, removed=True)
    warehouse.load_warehouse(now, folder)
    stored = warehouse.read_warehouse(spark, folder)
    assert figures(stored) == figures(now)
    assert spark_rows(business.biz_monthly_trend(stored)) == spark_rows(business.biz_monthly_trend(now))


def test_months_are_replaced_by_nothing_too(spark, tmp_path):
    folder = str(tmp_path)
    warehouse.load_warehouse(january_and_march(spark), folder)
    now = january_and_march(spark, moved=True, removed=True)
    assert warehouse.months_to_load(now, folder) == ["1995-01", "1995-03", None]
    with pytest.raises(ValueError, match="1995-03"):
        warehouse.load_warehouse(now, folder, ["1995-01", None])
    warehouse.load_warehouse(now, folder, ["1995-01", "1995-03", None])
    assert figures(warehouse.read_warehouse(spark, folder)) == figures(now)
    assert warehouse.months_to_load(now, folder) == []


def test_database_months_are_replaced_by_nothing_too(spark, tmp_path):
    spark.sql(f"CREATE DATABASE again LOCATION '{tmp_path}/again'")
    warehouse.create_schema(spark, "again")
    warehouse.load_database(january_and_march(spark), "again")
    now = january_and_march(spark, moved=True, removed=True)
    with pytest.raises(ValueError, match="1995-03"):
        warehouse.load_database(now, "again", ["1995-01", None])
    warehouse.load_database(now, "again", ["1995-01", "1995-03", None])
    assert figures(warehouse.read_database(spark, "again")) == figures(now)
    warehouse.load_database(january_and_march(spark), "again")
    assert figures(warehouse.read_database(spark, "again")) == figures(january_and_march(spark))
    spark.sql("DROP DATABASE again CASCADE")


def test_stored_copies_cannot_go_stale(spark, tmp_path):
    t = january_and_march(spark)
    for name in ("orders", "order_items", "order_reviews"):
        alone = type(t)(**{name: t[name]})
        with pytest.raises(ValueError, match="load"):
            warehouse.load_warehouse(alone, str(tmp_path / "x"))
    warehouse.load_warehouse(t, str(tmp_path / "w"))
    stored = warehouse.read_warehouse(spark, str(tmp_path / "w"))
    own = type(t)(**{n: stored[n] for n in ("orders", "order_items")})
    with pytest.raises(ValueError, match="is read by the plan"):
        warehouse.load_warehouse(own, str(tmp_path / "w"))


def test_layers_follow_gone_and_moved_orders(spark, tmp_path):
    folder, before = str(tmp_path), january_and_march(spark)
    layers.refresh_layers(before, folder)
    now = january_and_march(spark, moved=True, removed=True)
    with pytest.raises(ValueError, match="stale"):
        layers.attach_layers(now, spark, folder)
    assert layers.stale_months(now, spark, folder) == ["1995-01", "1995-03", None]
    with pytest.raises(ValueError, match="1995-03"):
        layers.refresh_layers(now, folder, ["1995-01", None])
    layers.refresh_layers(now, folder, layers.stale_months(now, spark, folder))
    attached = layers.attach_layers(now, spark, folder)
    assert spark_rows(business.biz_monthly_trend(attached)) == spark_rows(business.biz_monthly_trend(now))
    assert spark_rows(business.biz_core_kpis(attached)) == spark_rows(business.biz_core_kpis(now))
    assert attached.layer("order_facts").count() == 2


@pytest.fixture(scope="module")
def stored(spark, small_dir, tmp_path_factory):
    t, folder = role_tables(spark, small_dir), str(tmp_path_factory.mktemp("stored"))
    warehouse.load_warehouse(t, folder)
    return t, warehouse.read_warehouse(spark, folder)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan: str, column: str) -> list[str]:
    return [line for line in plan.splitlines() if "FileScan" in line and column in line]


@pytest.mark.parametrize(
    "report",
    [business.biz_core_kpis, business.biz_monthly_trend, business.biz_state_performance,
     logistics.log_seller, customers.person_rfm,
     lambda t: metrics.metric_table(t, list(metrics.SALES_MEASURES), ["state"])],
)
def test_stored_status_is_pushed_to_items(stored, report):
    t, kept = stored
    assert spark_rows(report(kept)) == spark_rows(report(t))
    (items,) = scans(plan_of(report(kept)), "price" if report is not logistics.log_seller else "seller_id")
    assert "EqualTo(order_status,delivered)" in items


def test_month_filter_prunes_orders_and_items(stored):
    t, kept = stored
    march = {"ym": F.col("ym") == F.lit("1996-03-01").cast("date")}

    def report(tables):
        return metrics.metric_table(tables, list(metrics.SALES_MEASURES), ["state"], march)

    assert spark_rows(report(kept)) == spark_rows(report(t))
    plan = plan_of(report(kept))
    for column in ("price", "order_status"):
        for scan in scans(plan, column):
            assert re.search(rf"PartitionFilters: \[[^\]]*{MONTH}", scan), scan


def test_month_filter_prunes_reviews(stored):
    t, kept = stored
    march = {"ym": F.col("ym") == F.lit("1996-03-01").cast("date")}
    for measures in (["avg_score"], list(metrics.ORDER_MEASURES)):

        def report(tables):
            return metrics.service_table(tables, measures, ["state"], march)

        assert spark_rows(report(kept)) == spark_rows(report(t))
        (reviews,) = scans(plan_of(report(kept)), "review_score")
        assert re.search(rf"PartitionFilters: \[[^\]]*{MONTH}", reviews), reviews


def test_service_reads_orders_once(stored):
    t, kept = stored
    for tables, column in ((t, "o_orderdate"), (kept, "order_purchase_timestamp")):
        report = metrics.service_table(tables, ["delivered", "late_rate"], ["ym"])
        assert len(scans(plan_of(report), column)) == 1
        assert len(scans(plan_of(layers.order_facts(tables)), column)) == 1


def test_refresh_of_a_month_reads_its_reviews_only(spark, stored, tmp_path):
    t, kept = stored
    layers.refresh_layers(kept, str(tmp_path), ["1996-03"], ["order_facts"])
    facts = layers.read_layer(spark, str(tmp_path), "order_facts")
    pruned = kept["order_reviews"].filter(F.col(MONTH).isin(["1996-03"]))
    assert re.search(r"PartitionFilters: \[[^\]]*purchase_ym", plan_of(pruned))
    scored = facts.filter("score IS NOT NULL").count()
    everything = layers.order_facts(t).filter((F.col(MONTH) == "1996-03") & F.col("score").isNotNull())
    assert scored == everything.count() > 0


def test_measures_side_by_side_keep_values_of_either_side(spark):
    t = shop(
        spark,
        orders=[order("a", "1995-01-05", arrived="1995-01-09", promised="1995-01-08"), order("b", "1995-01-06")],
        customers=[customer("c-a", "p", "SP"), customer("c-b", "q", "RJ")],
        order_items=[item("a", 1, 10, seller="s1"), item("a", 2, 5, seller="s2"), item("b", 1, 7)],
        order_reviews=[review("r", "a", 2)],
    )
    table = metrics.measure_table(t, ["gmv", "late_rate", "avg_score"], ["seller_id"])
    got = {r["seller_id"]: (r["gmv"], r["late_rate"], r["avg_score"]) for r in rows(table)}
    assert got == {"s1": (17.0, 100.0, 2.0), "s2": (5.0, 100.0, 2.0)}
    by_state = metrics.measure_table(t, ["gmv", "delivered"], ["state"])
    assert {r["state"]: (r["gmv"], r["delivered"]) for r in rows(by_state)} == {
        "SP": (15.0, 1), "RJ": (7.0, None),
    }
    assert rows(metrics.measure_table(t, ["gmv", "delivered"]))[0] == {"gmv": 22.0, "delivered": 1}


def test_rfm_takes_unknown_purchases_as_nulls_sort(spark):
    """Ascending NULLs come first (recency), descending ones last; ties of F go by person."""
    people = [f"p{i:02d}" for i in range(10)]
    bought = ["1995-01-10", None, *(f"1995-02-{i:02d}" for i in range(1, 9))]
    t = shop(
        spark,
        orders=[order(p, b) for p, b in zip(people, bought)],
        customers=[customer(f"c-{p}", p) for p in people],
        order_items=[item(p, 1, 10 * i) for i, p in enumerate(people) if i != 9],
    )
    got = {r["person"]: r for r in rows(customers.rfm_bands(t))}
    assert {p for p in got if got[p]["r_band"] == "near"} == {"p01", "p09", "p08"}
    assert {p for p in got if got[p]["f_band"] == "high"} == {"p00", "p01", "p02"}
    assert {p for p in got if got[p]["m_band"] == "high"} == {"p08", "p07", "p06"}
    assert sum(r["persons"] for r in rows(derived.rfm_segments(t))) == 10


def test_rfm_ranks_only_people_around_the_cuts(spark, small_dir, monkeypatch):
    ranked = []
    real = customers.with_rank
    monkeypatch.setattr(customers, "with_rank", lambda df, *o: ranked.append(df.count()) or real(df, *o))
    t = role_tables(spark, small_dir)
    people = customers.rfm_bands(t).count()
    assert ranked and ranked[0] <= people


def test_no_period_is_cut_off(spark):
    """A hundred months of one person."""
    start = datetime(1990, 1, 15)
    bought = [(start + timedelta(days=30.44 * i)).strftime("%Y-%m-15") for i in range(100)]
    t = shop(
        spark,
        orders=[order(f"o{i}", b, customer="c") for i, b in enumerate(bought)],
        customers=[customer("c", "p")],
    )
    grid = rows(pages.cohort_grid(t))
    last = max(r["period"] for r in grid)
    assert last >= 99 and len(grid) == last
    assert sum(r["retention_pct"] is not None for r in grid) == len(set(b[:7] for b in bought))
    assert len(pages.cohort_matrix(t).columns) == last + 2
    with pytest.raises(ValueError, match="periods"):
        pages.cohort_matrix(t, periods=84)
    assert rows(pages.cohort_grid(shop(spark))) == []


def test_written_tables_can_be_removed(spark):
    kept = written(spark.range(5))
    assert kept.count() == 5
    remove_written(spark)
    folder = f"{shared_folder(spark)}/stallworks/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_changed_tables_differ(spark, small_dir):
    t = role_tables(spark, small_dir)
    now = _changed(t)
    assert 0 < now["orders"].count() < t["orders"].count()


def test_a_single_task_read_has_to_be_asked_for(spark):
    with pytest.raises(ValueError, match="single_task"):
        warehouse.read_jdbc(spark, "jdbc:none", "t", {})
