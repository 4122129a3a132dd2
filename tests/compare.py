"""Run registered queries in Spark and their SQL in DuckDB and compare the rows exactly."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        return float(value) if isinstance(value, Decimal) else value

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _rows(df.columns, df.collect())


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), _rows(names, cursor.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None if both sides agree in columns, types and every value."""
    spark_names, ours = spark_rows(df)
    sql_names, theirs = sql_rows(con, sql)
    if spark_names != sql_names:
        return f"columns {spark_names} != {sql_names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)]
    return f"{len(wrong)} rows differ, first: {wrong[0]}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    folder, *only = sys.argv[1:] or ["/root/testdata/sf0.01"]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(folder), contract.oracle_sql(), 0
    for name, query in contract.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            result = query(spark, folder)
            problem = difference(result, con, sql[name]) if name in sql else "no SQL"
            rows = result.count() if only else ""
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{name:36s} {time.time() - start:6.2f}s {rows} {problem or 'ok'}", flush=True)
    print("unregistered SQL:", sorted(set(sql) - set(contract.queries())), "bad:", bad)
