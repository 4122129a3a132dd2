"""Tables stored by purchase month: replacing all of them, or named months only."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stallworks.functions.expressions import month_label, month_start
from stallworks.sources.schemas import MONTH

# The folder in which Spark stores rows without a partition value (a fixed name).
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"

# A month as yyyy-MM, or None for rows without a purchase time.
Month = str | None


def month_of_purchase() -> Column:
    return month_label(month_start(F.col("order_purchase_timestamp"))).alias(MONTH)


def month_date(columns: Sequence[str]) -> Column:
    """First day of the purchase month; from the partition column where a table has it."""
    if MONTH in columns:
        return F.to_date(F.col(MONTH), "yyyy-MM")
    return month_start(F.col("order_purchase_timestamp"))


def among(column: Column, months: Sequence[Month]) -> Column:
    named = [m for m in months if m is not None]
    inside = column.isin(named) if named else F.lit(False)
    return F.coalesce(inside, F.lit(False)) | (column.isNull() if None in months else F.lit(False))


def refuse_own_source(df: DataFrame, path: str) -> None:
    """Overwriting what the plan still has to read would lose it."""
    target = urlparse(path).path.rstrip("/") + "/"
    if any(urlparse(f).path.startswith(target) for f in df.inputFiles()):
        raise ValueError(f"{path} is read by the plan that is to replace it")


# Into so many tasks the rows of a month are spread at most where they are gathered by month.
MONTH_SLOTS = 8


def gathered(rows: DataFrame, *keys: str) -> tuple[DataFrame, str]:
    """Rows spread by month and a hash of some keys, and the column that says where to.

    Grouped by month, these keys, that column and whatever else, they need no further exchange, and
    neither does writing the groups by month.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(MONTH_SLOTS))
    return rows.withColumn("_slot", slot).repartition(MONTH, "_slot"), "_slot"


def replace_months(
    df: DataFrame,
    path: str,
    months: Sequence[Month] | None = None,
    arranged: bool = False,
    from_itself: bool = False,
) -> None:
    """Write a table by month.

    Without ``months`` the whole table is replaced, months that are gone included. With them each
    named month is replaced, by nothing if it has no rows any more; the others stay.
    The rebalance hint gathers a month into few files and splits one too large for a task; rows
    that are ``arranged`` by month already are written as they come. Named months may be made
    ``from_itself``: Spark writes them beside the table and moves them in when all rows are read.
    """
    if months is None or not from_itself:
        refuse_own_source(df, path)

    def by_month(rows: DataFrame) -> DataFrame:
        return rows if arranged else rows.hint("rebalance", MONTH)

    if months is None:
        (
            by_month(df)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy(MONTH)
            .parquet(path)
        )
        return
    seen = Observation()
    rows = by_month(df.filter(among(F.col(MONTH), months)))
    (
        rows.observe(seen, F.collect_set(F.coalesce(F.col(MONTH), F.lit(NO_MONTH))).alias("months"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )
    nothing = df.sparkSession.createDataFrame([], df.drop(MONTH).schema)
    for month in {NO_MONTH if m is None else m for m in months} - set(seen.get["months"] or ()):
        nothing.write.mode("overwrite").parquet(f"{path}/{MONTH}={month}")


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.withColumn(MONTH, F.col(MONTH).cast("string"))


def moved(now: DataFrame, before: DataFrame) -> DataFrame:
    """Orders in both that changed month: ``(now, was)``, one row per pair of months."""
    return (
        now.select("order_id", F.col(MONTH).alias("now"))
        .join(before.select("order_id", F.col(MONTH).alias("was")), "order_id")
        .filter(~F.col("now").eqNullSafe(F.col("was")))
        .select("now", "was")
        .distinct()
    )


def refuse_half_moves(now: DataFrame, before: DataFrame, months: Sequence[Month]) -> None:
    """Replacing only one of an order's two months would store it twice or not at all."""
    inside, was_inside = among(F.col("now"), months), among(F.col("was"), months)
    # Pairs of months at most, whatever the number of orders.
    half = moved(now, before).filter(inside != was_inside).collect()
    also = sorted({m for r in half for m in r if m not in months}, key=str)
    if also:
        raise ValueError(f"orders moved between months; name these too: {also}")
