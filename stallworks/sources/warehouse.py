"""Cleaned tables as a warehouse: reading, declaring, loading, monthly clustering, JDBC."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.operators.ranking import written
from stallworks.sources.fingerprints import different_months, fingerprints, whole_table
from stallworks.sources.formats import format_options
from stallworks.sources.monthly import (
    NO_MONTH,
    Month,
    among,
    gathered,
    month_of_purchase,
    read_monthly,
    refuse_half_moves,
    refuse_own_source,
    replace_months,
)
from stallworks.sources.schemas import (
    FOREIGN_KEYS,
    MONTH,
    PRIMARY_KEYS,
    SCHEMAS,
    STORED_EXTRAS,
    TABLE_NAMES,
    nullable_schema,
)
from stallworks.sources.tables import Tables

@dataclass(frozen=True)
class Loaded:
    tables: Tables
    missing: tuple[str, ...]


def read_clean(spark: SparkSession, folder: str, fmt: str = "parquet") -> Loaded:
    """Read the cleaned tables, parents first; absent ones are reported and skipped.

    A CSV table may be a folder ``orders`` or a single file ``orders.csv``.
    """
    suffix = "{,.csv}" if fmt == "csv" else ""
    found, missing = {}, []
    for name in TABLE_NAMES:
        reader = spark.read.format(fmt).schema(nullable_schema(name))
        reader = reader.options(**format_options(fmt, name))
        try:
            found[name] = reader.load(f"{folder}/{name}{suffix}")
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            missing.append(name)
    return Loaded(Tables(**found), tuple(missing))


def create_statements(database: str) -> list[str]:
    """CREATE TABLE for every table, with its keys and references as properties.

    Spark does not enforce them; the check jobs test them.
    """
    statements = []
    for name in TABLE_NAMES:
        columns = [
            f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}"
            for f in SCHEMAS[name].fields
        ]
        columns += [f"{extra} string" for extra in STORED_EXTRAS.get(name, ())]
        partitioning = f" PARTITIONED BY ({MONTH})" if name in STORED_EXTRAS else ""
        properties = {"primary_key": ",".join(PRIMARY_KEYS[name])}
        for ref in FOREIGN_KEYS:
            if ref.child == name:
                properties[f"references.{ref.column}"] = ref.parent
        declared = ", ".join(f"'{k}'='{v}'" for k, v in properties.items())
        statements.append(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({', '.join(columns)})"
            f" USING parquet{partitioning} TBLPROPERTIES ({declared})"
        )
    return statements


def create_schema(spark: SparkSession, database: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for statement in create_statements(database):
        spark.sql(statement)


def with_extras(t: Tables, name: str) -> DataFrame:
    """A table as it is stored: contract columns, then what it copies from its order."""
    extras = STORED_EXTRAS.get(name, ())
    contract = t[name].drop(*[c for c in extras if c not in SCHEMAS[name].names])
    if name == "orders":
        return contract.select("*", month_of_purchase())
    if extras:
        of_order = t["orders"].select("order_id", "order_status", month_of_purchase())
        return contract.join(of_order.select("order_id", *extras), "order_id", "left")
    return contract


def _refuse_parts(t: Tables) -> None:
    """Items, payments and reviews copy columns of their orders; stored copies must not go stale."""
    present = set(t.present())
    if "orders" in present and "order_items" not in present:
        raise ValueError("load order_items with orders: stored items copy the status of their order")
    alone = sorted(set(STORED_EXTRAS) & present)
    if alone and "orders" not in present:
        raise ValueError(f"load orders with {alone}: they copy columns of their orders")


def load_warehouse(
    t: Tables, folder: str, months: Sequence[Month] | None = None
) -> dict[str, str]:
    """Write every present table to Parquet and return the paths.

    A rerun replaces what it wrote. With ``months`` only those months of the monthly tables are
    replaced (None names the rows without a month), by nothing where they are empty now;
    an order that changed month needs both named, which is checked.
    """
    _refuse_parts(t)
    paths = {name: f"{folder}/{name}" for name in t.present()}
    if months is not None and "orders" in paths:
        before = read_monthly(t["orders"].sparkSession, paths["orders"])
        refuse_half_moves(with_extras(t, "orders"), before, months)
    for name, path in paths.items():
        if name in STORED_EXTRAS:
            replace_months(with_extras(t, name), path, months)
        else:
            refuse_own_source(t[name], path)
            t[name].write.mode("overwrite").parquet(path)
    return paths


def months_to_load(t: Tables, folder: str) -> list[Month]:
    """Months in which orders, items, payments or reviews differ from the stored ones."""
    stored = read_warehouse(t["orders"].sparkSession, folder)
    parts = {name: whole_table(name) for name in STORED_EXTRAS if name in t.present()}
    return different_months(fingerprints(t, parts), fingerprints(stored, parts))


def _merged_by_key(changed: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = stored.join(changed.select(*keys).distinct(), list(keys), "left_anti")
    return rest.select(changed.columns).unionAll(changed)


_STORED, _MARK, _NEW = 0, 1, 2


def _merged_by_order(new: DataFrame, before: DataFrame, ids: DataFrame) -> DataFrame:
    """Stored rows of all orders but ``ids``, and the new rows, gathered by month.

    Stored rows move once: a mark for each month that such an order has rows in goes where these
    rows go, and takes them out there.
    """
    marks = before.select("order_id", MONTH).join(ids, "order_id", "left_semi").distinct()
    rows = (
        before.select(new.columns)
        .withColumn("_kind", F.lit(_STORED))
        .unionByName(marks.withColumn("_kind", F.lit(_MARK)), allowMissingColumns=True)
        .unionByName(new.withColumn("_kind", F.lit(_NEW)))
    )
    rows, slot = gathered(rows, "order_id")
    kind = F.col("_kind")
    marked = F.max(kind == _MARK).over(Window.partitionBy(MONTH, slot, "order_id"))
    return (
        rows.withColumn("_marked", marked)
        .filter((kind == _NEW) | ((kind == _STORED) & ~F.col("_marked")))
        .select(new.columns)
    )


def merge_orders(
    changed: Tables, folder: str, removed: DataFrame | None = None
) -> list[Month]:
    """Replace single orders in a loaded warehouse; the months that were rewritten.

    ``changed`` holds new and changed orders, each whole: its row and all of its items,
    payments and reviews; ``removed`` has the ``order_id`` of orders that are gone. Rows of other
    tables in ``changed`` replace stored rows of the same primary key. Only months that such
    an order is in now or was in before are read and written. What is changed is written beside
    the warehouse first, as it may be made from what it replaces. Orders are replaced after
    what belongs to them, so that a merge that was cut short finds the same months again.
    """
    spark = changed["orders"].sparkSession
    stored = read_warehouse(spark, folder)
    ids = changed["orders"].select("order_id")
    ids = written((ids if removed is None else ids.unionAll(removed.select("order_id"))).distinct())
    now = with_extras(changed, "orders").select(MONTH)
    was = stored["orders"].join(ids, "order_id", "left_semi").select(MONTH)
    months = sorted((r[0] for r in now.unionAll(was).distinct().collect()), key=str)
    fresh = {}
    for name in changed.present():
        new = with_extras(changed, name)
        if name not in STORED_EXTRAS:
            new = _merged_by_key(new, stored[name], PRIMARY_KEYS[name])
        fresh[name] = written(new)
    for name in reversed(fresh):
        if name in STORED_EXTRAS:
            before = stored[name].filter(among(F.col(MONTH), months))
            table = _merged_by_order(fresh[name], before, ids)
            replace_months(table, f"{folder}/{name}", months, arranged=True, from_itself=True)
        else:
            fresh[name].write.mode("overwrite").parquet(f"{folder}/{name}")
    return months


_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def load_database(t: Tables, database: str, months: Sequence[Month] | None = None) -> None:
    """Fill the declared tables; a rerun replaces what it wrote, as ``load_warehouse`` does."""
    _refuse_parts(t)
    spark = t[t.present()[0]].sparkSession
    if months is not None and "orders" in t.present():
        refuse_half_moves(with_extras(t, "orders"), spark.table(f"{database}.orders"), months)
    mode = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "static" if months is None else "dynamic")
    try:
        for name in t.present():
            extras = STORED_EXTRAS.get(name, ())
            table, target = with_extras(t, name).select(*SCHEMAS[name].names, *extras), f"{database}.{name}"
            if not extras:
                spark.conf.set(_OVERWRITE, "static")
                table.write.mode("overwrite").insertInto(target)
                spark.conf.set(_OVERWRITE, "static" if months is None else "dynamic")
            elif months is None:
                table.hint("rebalance", MONTH).write.mode("overwrite").insertInto(target)
            else:
                _insert_months(table, target, months)
    finally:
        spark.conf.set(_OVERWRITE, mode)


def _insert_months(table: DataFrame, target: str, months: Sequence[Month]) -> None:
    """One INSERT for all named months; months that have no rows any more are dropped."""
    seen = Observation()
    rows = table.filter(among(F.col(MONTH), months)).hint("rebalance", MONTH)
    found = F.collect_set(F.coalesce(F.col(MONTH), F.lit(NO_MONTH))).alias("months")
    rows.observe(seen, found).write.mode("overwrite").insertInto(target)
    present = set(seen.get["months"] or ())
    for month in months:
        if (NO_MONTH if month is None else month) not in present:
            value = "null" if month is None else f"'{month}'"
            table.sparkSession.sql(f"ALTER TABLE {target} DROP IF EXISTS PARTITION ({MONTH} = {value})")


def read_database(spark: SparkSession, database: str) -> Tables:
    return Tables(**{name: partial(spark.table, f"{database}.{name}") for name in TABLE_NAMES})


def read_warehouse(spark: SparkSession, folder: str) -> Tables:
    """The loaded tables; a filter on ``purchase_ym`` prunes months of the monthly ones."""

    def stored(name: str) -> DataFrame:
        path = f"{folder}/{name}"
        if name not in STORED_EXTRAS:
            return spark.read.parquet(path)
        try:
            return read_monthly(spark, path)
        except AnalysisException as problem:
            if "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
            # A table by month that holds no rows has no file that could tell its columns.
            extras = [T.StructField(extra, T.StringType()) for extra in STORED_EXTRAS[name]]
            return spark.createDataFrame([], T.StructType([*nullable_schema(name).fields, *extras]))

    return Tables(**{name: partial(stored, name) for name in TABLE_NAMES})


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    split_column: str | None = None,
    bounds: tuple[object, object] | None = None,
    parts: int = 1,
    single_task: bool = False,
) -> DataFrame:
    """A table of a relational database, read in parallel slices of ``split_column``.

    A table without a column to split by is read by one task, which has to be asked for.
    """
    if split_column is None or bounds is None:
        if not single_task:
            raise ValueError("give split_column and bounds, or ask for single_task")
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(
        url,
        table,
        column=split_column,
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=parts,
        properties=properties,
    )


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a database table in batches of 5,000 rows."""
    df.write.option("batchsize", 5000).jdbc(url, table, mode="append", properties=properties)
