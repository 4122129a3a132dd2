"""Measures from stored grains equal those from orders, and the smallest able grain is read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stallworks.operators.lattice import Grain, grain, grain_of, serving_layer
from stallworks.plans import layers, metrics
from stallworks.sources.roles import role_tables
from stallworks.sources.schemas import MONTH
from tests.compare import spark_rows
from tests.shop import customer, item, order, product, review, shop

SALES, SERVICE = list(metrics.SALES_MEASURES), list(metrics.ORDER_MEASURES)
STORED = [
    grain(["state"]),
    grain(["state", "city"], people=True),
    grain(["category"], people=True),
    grain(["seller_id", "seller_state"]),
    grain(["category", "state"], people=True),
]


def odd_shop(spark):
    """Orders without items, parents, dates or reviews; repeated rows; two labels in an order."""
    sellers = [
        {"seller_id": "s1", "seller_state": "SP", "seller_city": "a"},
        {"seller_id": "s2", "seller_state": None, "seller_city": "b"},
    ]
    t = shop(
        spark,
        orders=[
            order("a", "1995-01-05", arrived="1995-01-09", promised="1995-01-08"),
            order("b", "1995-01-06", arrived="1995-01-07", promised=None),
            order("c", "1995-02-01", arrived=None, promised="1995-02-09"),
            order("d", None, arrived="1995-02-03", promised="1995-02-09"),
            order("e", "1995-02-05", status="canceled", arrived="1995-02-06", promised="1995-02-07"),
            order("f", "1995-02-07", arrived="1995-02-08", promised="1995-02-08"),
            order("g", "1995-03-07", status=None),
            order("h", "1995-03-07", customer="nobody"),
        ],
        customers=[
            customer("c-a", "p"), customer("c-b", "p", "RJ"), customer("c-c", "p"),
            customer("c-d", "q", None), customer("c-e", "q"), customer("c-f", "p", "RJ"),
            customer("c-g", None),
        ],
        order_items=[
            item("a", 1, 5), item("a", 2, 6, product="p2", seller="s2"), item("a", 2, 6, product="p2", seller="s2"),
            item("a", 3, 2, product="p3"), item("b", 1, None), item("d", 1, 9, product="lost"),
            item("e", 1, 4, seller="lost"), item("f", 1, 3, product=None, seller="s2"),
            item("h", 1, 8), item("nowhere", 1, 7),
        ],
        order_reviews=[
            review("r1", "a", 5), review("r2", "a", 2), review("r3", "b", 1), review("r4", "f", None),
        ],
        products=[product("p1", "toys"), product("p2", "books"), product("p3", None)],
        sellers=sellers,
    )
    one_label = spark.createDataFrame([("toys", "fun"), ("books", "fun")], t["category_name"].schema)
    return t.replaced(category_name=one_label)


SP, FUN = {"state": "state = 'SP'"}, {"category": "category = 'fun'"}
JANUARY = {"ym": "ym = date'1995-01-01'"}
REQUESTS = [
    (SALES, [], {}),
    (SALES, ["ym"], SP),
    (SALES, ["state", "ym"], {}),
    (["valid_orders", "aov"], ["state"], JANUARY),
    (SALES, ["category"], {}),
    (SALES, ["category", "state"], FUN),
    (["gmv", "freight"], ["state"], FUN),
    (["gmv", "freight"], ["seller_state"], JANUARY),
    (["gmv", "valid_orders", "aov"], ["seller_id", "seller_state"], {}),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    t, folder = odd_shop(spark), str(tmp_path_factory.mktemp("grains"))
    names = [g.name for g in STORED]
    layers.refresh_layers(t, folder, names=names)
    return t, layers.attach_layers(t, spark, folder, names)


def served(t, measures, dims, filters):
    return serving_layer(t, measures, dims, filters)


def test_sales_from_grains_equal_sales_from_orders(odd):
    t, attached = odd
    for measures, dims, conditions in REQUESTS:
        assert served(attached, measures, dims, conditions)
        filters = {dim: F.expr(condition) for dim, condition in conditions.items()}
        stored = metrics.metric_table(attached, measures, dims, filters)
        assert spark_rows(stored) == spark_rows(metrics.metric_table(t, measures, dims, filters))


@pytest.mark.parametrize(
    "dims, status",
    [
        ([], "nothing"), (["ym"], "delivered"), (["state"], "canceled"),
        (["category", "state"], "delivered"),
    ],
)
def test_service_from_grains_equals_service_from_orders(odd, dims, status):
    t, attached = odd
    assert served(attached, SERVICE, dims, {})
    stored = metrics.service_table(attached, SERVICE, dims, status=status)
    assert spark_rows(stored) == spark_rows(metrics.service_table(t, SERVICE, dims, status=status))
    by_instant = metrics.service_table(attached, SERVICE, dims, sla_grain="timestamp")
    assert "measures" not in "".join(by_instant.inputFiles())


def test_no_rows_give_zeros_and_nulls(odd):
    t, attached = odd
    for dims in ([], ["ym"]):
        stored = metrics.metric_table(attached, SALES, dims, status="nothing")
        assert spark_rows(stored) == spark_rows(metrics.metric_table(t, SALES, dims, status="nothing"))


def test_what_can_be_derived():
    by_category = grain(["category"], people=True)
    assert by_category.answers(SALES, ["category"], ["ym"])
    assert by_category.answers(["gmv"], [], ["category"])
    # An order of two categories is two rows: it counts once in a total, and once per category.
    assert not by_category.answers(["valid_orders"], ["ym"], ["category"])
    # Orders without items are in no category.
    assert not by_category.answers(["gmv"], ["ym"], [])
    assert not grain(["category"]).answers(["buyers"], ["category"], [])
    assert not grain(["category"]).answers(["gmv"], ["category"], ["state"])
    sellers = grain(["seller_id", "seller_state"])
    assert sellers.answers(["aov"], ["seller_id"], ["seller_state"])
    assert not sellers.answers(["aov"], ["seller_state"], [])
    assert sellers.answers(["gmv"], ["seller_state"], [])
    # Lines whose seller is unknown are in no state, but still of their seller id.
    assert not sellers.answers(["gmv"], ["seller_id"], [])
    assert not grain(["state"]).answers(["delivered"], ["payment_type"], [])
    assert grain_of(sellers.name) == sellers and grain_of("seller_months") is None
    assert grain(["city", "ym", "state"], True) == Grain(("state", "city"), True)
    with pytest.raises(ValueError, match="unknown"):
        grain(["colour"])


def read_by(df) -> set[str]:
    return {part for path in df.inputFiles() for part in path.split("/") if part.startswith("measures")}


def test_the_smallest_able_grain_is_read(spark, small_dir, tmp_path):
    t, folder = role_tables(spark, small_dir), str(tmp_path)
    grains = [grain([]), grain(["state"]), grain(["state"], people=True), grain(["category", "state"])]
    layers.refresh_layers(t, folder, names=[g.name for g in grains])
    attached = layers.attach_layers(t, spark, folder, [g.name for g in grains])
    march = {"ym": F.col("ym") == F.lit("1996-03-01").cast("date")}

    def sales(measures, dims=(), filters=None):
        return metrics.metric_table(attached, measures, list(dims), filters)

    assert read_by(sales(["gmv"], ["ym"])) == {"measures"}
    assert read_by(sales(["aov"], ["state"])) == {"measures.state"}
    assert read_by(sales(["buyers"], ["ym"])) == {"measures.state.person"}
    assert read_by(sales(["gmv"], ["category"])) == {"measures.state.category"}
    assert read_by(metrics.service_table(attached, SERVICE, ["state"])) == {"measures.state"}
    assert read_by(sales(["buyers"], ["category"])) == set()
    assert read_by(metrics.service_table(attached, SERVICE, ["payment_type"])) == set()
    pruned = sales(["gmv"], ["state"], march)._jdf.queryExecution().executedPlan().toString()
    assert MONTH in pruned.split("PartitionFilters: ")[1].split("]")[0]
    both = metrics.measure_table(attached, SALES + SERVICE, ["state"])
    assert read_by(both) == {"measures.state", "measures.state.person"}
    assert spark_rows(both) == spark_rows(metrics.measure_table(t, SALES + SERVICE, ["state"]))


@pytest.mark.parametrize(
    "table, column, key, touched",
    [
        ("customers", "customer_state", "c-f", {"measures.state", "measures.state.city.person",
            "measures.category.person", "measures.seller_id.seller_state",
            "measures.state.category.person"}),
        ("sellers", "seller_state", "s2", {"measures.seller_id.seller_state"}),
        ("category_name", "product_category_name_english", "books", {"measures.category.person",
            "measures.state.category.person"}),
        ("order_reviews", "review_score", "r4", {g.name for g in STORED}),
    ],
)
def test_changed_parents_make_grains_stale(spark, tmp_path, table, column, key, touched):
    t, folder, names = odd_shop(spark), str(tmp_path), [g.name for g in STORED]
    layers.refresh_layers(t, folder, names=names)
    value = F.lit(3) if table == "order_reviews" else F.lit("new")
    new = F.when(F.col(t[table].columns[0]) == key, value).otherwise(F.col(column))
    now = t.replaced(**{table: t[table].withColumn(column, new.cast(t[table].schema[column].dataType))})
    stale = layers.stale_layers(now, spark, folder, names)
    assert {name for name, months in stale.items() if months} == touched
    name = sorted(touched)[0]
    layers.refresh_layers(now, folder, stale[name], [name])
    attached = layers.attach_layers(now, spark, folder, [name])
    dims = list(grain_of(name).dims)
    assert served(attached, ["gmv", "freight"], dims, {}) == name
    assert spark_rows(metrics.metric_table(attached, ["gmv", "freight"], dims)) == spark_rows(
        metrics.metric_table(now, ["gmv", "freight"], dims)
    )


def test_a_product_that_comes_late_makes_its_lines_stale(spark, tmp_path):
    t, folder, name = odd_shop(spark), str(tmp_path), grain(["category"], people=True).name
    layers.refresh_layers(t, folder, names=[name])
    late = spark.createDataFrame([("lost", None)], "product_id string, product_category_name string")
    now = t.replaced(products=t["products"].unionByName(late, allowMissingColumns=True))
    assert layers.stale_months(now, spark, folder, [name]) == [None]
