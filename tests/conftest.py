from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA_DIR", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("stallworks-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def check_dir() -> str:
    return str(TESTDATA / os.environ.get("TEST_SF", "sf0.01"))


@pytest.fixture(scope="session")
def hot_dir(check_dir, tmp_path_factory) -> str:
    """A third of all rows on one order, product, seller, person and review; some NULLs."""
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    changed = {
        "lineitem": """
            SELECT * EXCLUDE (i) REPLACE (
                CASE WHEN i % 3 = 0 THEN 5 ELSE l_orderkey END AS l_orderkey,
                CASE WHEN i % 7 = 3 THEN NULL WHEN i % 3 = 1 THEN 9 ELSE l_partkey END AS l_partkey,
                CASE WHEN i % 3 <> 2 THEN 4 ELSE l_suppkey END AS l_suppkey,
                CASE WHEN i % 11 = 5 THEN NULL ELSE l_extendedprice END AS l_extendedprice)
            FROM (SELECT *, row_number() OVER () AS i FROM src)""",
        "orders": """
            SELECT * REPLACE (
                CASE WHEN o_orderkey % 3 = 1 THEN 77 ELSE o_custkey END AS o_custkey,
                CASE WHEN o_orderkey % 3 = 2 THEN date_trunc('month', o_orderdate)
                     ELSE o_orderdate END AS o_orderdate,
                CASE WHEN o_orderkey = 5 THEN 'F' ELSE o_orderstatus END AS o_orderstatus)
            FROM src""",
        "events": """
            SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 8 ELSE event_id END AS event_id)
            FROM src""",
    }
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(
            f"CREATE OR REPLACE VIEW src AS SELECT * FROM '{check_dir}/{name}.parquet'"
        )
        body = changed.get(name, "SELECT * FROM src")
        con.execute(f"COPY ({body}) TO '{folder}/{name}.parquet' (FORMAT parquet, ROW_GROUP_SIZE 4096)")
    return str(folder)
