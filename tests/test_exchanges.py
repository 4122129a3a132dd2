"""What the plans of layers move: each row once per step."""

from __future__ import annotations

import re

import pytest

from stallworks.operators import lattice
from stallworks.plans import layers
from stallworks.plans.metrics import grain_table
from stallworks.registry import registered_queries
from stallworks.sources.fingerprints import different_months, fingerprints
from stallworks.sources.quoted_records import quoted_records
from stallworks.sources.roles import role_tables
from tests.compare import spark_rows
from tests.shop import customer, item, order, product, shop


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dims", [["category"], ["seller_state"]])
def test_lines_of_a_grain_are_sent_to_their_order_once(spark, small_dir, no_broadcast, dims):
    t = role_tables(spark, small_dir)
    plan = plan_of(grain_table(t, lattice.grain(dims, people=True)))
    assert "hashpartitioning(order_id" in plan
    assert not re.search(rf"hashpartitioning\(order_id#\d+L?, {dims[0]}", plan)
    # Groups are made where their month is written, without partial sums sent before.
    assert re.search(r"hashpartitioning\(purchase_ym#\d+, _slot", plan)


@pytest.mark.parametrize("name", ["layer_refresh_prices_metric_sales_by_category", "layer_refresh_partial_monthly_trend"])
def test_a_refresh_scans_what_is_new_once(spark, small_dir, monkeypatch, name):
    taken, real = [], layers.fingerprints
    monkeypatch.setattr(layers, "fingerprints", lambda *a: taken.append(a) or real(*a))
    registered_queries()[name](spark, small_dir)
    # As stored first, as they are now, and once more where the layers are verified.
    assert len(taken) == 3


@pytest.mark.parametrize("dims", [["category"], ["seller_state"], ["product_id"]])
def test_amounts_of_an_item_grain_are_fingerprinted_once(dims):
    parts = layers.layer_parts(lattice.grain(dims, people=True).name)
    assert [p for p, (_, columns) in parts.items() if "price" in columns] == [
        p for p in parts if p.endswith("_of_grain") and not p.startswith("buyers")
    ]


def test_fingerprints_join_hashes_of_parents(spark, no_broadcast):
    t = shop(
        spark,
        orders=[order("a", "1995-01-05")],
        customers=[customer("c-a", "p")],
        order_items=[item("a", 1, 5, product="x")],
        products=[product("x", "toys")],
    )
    parts = layers.layer_parts(lattice.grain(["category"], people=True).name)
    exchanged = [
        line for line in plan_of(fingerprints(t, parts)).split("\n")
        if "Exchange hashpartitioning(_customer_id" in line or "Exchange hashpartitioning(_product_id" in line
    ]
    assert exchanged
    moved = shop(
        spark,
        orders=[order("a", "1995-01-05")],
        customers=[customer("c-a", "p", state="RJ")],
        order_items=[item("a", 1, 5, product="x")],
        products=[product("x", "toys")],
    )
    assert different_months(fingerprints(t, parts), fingerprints(moved, parts)) == ["1995-01"]
    # A product that is known without a category is another thing than an unknown one.
    unnamed = t.replaced(products=t["products"].selectExpr("product_id", "cast(NULL AS string) AS product_category_name"))
    unknown = t.replaced(products=t["products"].limit(0))
    by_raw = {"categories": ("order_items", ("order_id", "product_category_name", "price"))}
    assert different_months(fingerprints(unnamed, by_raw), fingerprints(unknown, by_raw)) == ["1995-01"]


@pytest.mark.parametrize("layer", ["seller_months", "product_months"])
def test_lines_of_a_layer_are_sent_to_their_order_once(spark, small_dir, no_broadcast, layer, tmp_path):
    t = role_tables(spark, small_dir)
    key = {"seller_months": "seller_id", "product_months": "product_id"}[layer]
    plan = plan_of(layers.LAYERS[layer](t))
    assert not re.search(rf"hashpartitioning\({key}#\d+L?, order_id", plan)
    layers.refresh_layers(t, str(tmp_path), names=[layer])
    assert spark_rows(layers.read_layer(spark, str(tmp_path), layer).drop("gmv")) == spark_rows(
        layers.LAYERS[layer](t).select(layers.read_layer(spark, str(tmp_path), layer).columns).drop("gmv")
    )
    files = [len(list(month.glob("*.parquet"))) for month in (tmp_path / layer).glob("purchase_ym=*")]
    assert max(files) <= 8


def test_review_lines_are_numbered_in_chunks_of_a_range(spark, tmp_path):
    lines = "".join(f'r{i},"one\n""two""\nthree"\n' for i in range(12_000))
    (tmp_path / "a.csv").write_text("review_id,message\n" + lines)
    found = quoted_records(spark, str(tmp_path))
    windows = [line for line in plan_of(found).split("\n") if "row_number()" in line]
    assert windows and all("chunk#" in line for line in windows)
    rows = found.orderBy("block", "row").collect()
    assert (rows[0].block, rows[0].row, rows[0].record) == (0, 1, "review_id,message")
    assert [r.record for r in rows[1:]] == [f'r{i},"one\n""two""\nthree"' for i in range(12_000)]
