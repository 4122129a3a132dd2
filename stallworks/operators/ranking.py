"""Exact global ranks, running sums and cut points without a one-partition window.

Rows are range-partitioned on the full sort key (tie-break included, so heavy ties
spread over partitions) and sorted inside each one. A row's global place is its place
in its slice plus the sizes of the slices before it; only one row per slice is ever
combined in one task.

Spark picks range bounds by sampling, so two uses of one plan could be sliced
differently. The sliced rows are therefore written once to the shared checkpoint
folder and read back: places are data from then on, also if executors are lost.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallworks.functions.expressions import first_match

# monotonically_increasing_id puts the partition number above 33 bits of row position.
_POSITION_BITS = 33


@lru_cache(maxsize=1)
def _private_folder() -> str:
    return tempfile.mkdtemp(prefix="stallworks-")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _private_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps what it writes for itself."""
    return f"{shared_folder(spark)}/stallworks/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and continue from there."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Delete what this application has written with ``written``; only after results are taken."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sliced(df: DataFrame, *order: Column) -> DataFrame:
    """Globally sorted rows with ``_slice`` and the place ``_at`` within the slice."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    return (
        placed.withColumn("_slice", F.shiftright("_pos", _POSITION_BITS))
        .withColumn("_at", F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_pos")
    )


def _preceding(per_slice: DataFrame, *columns: str) -> DataFrame:
    """Exclusive running totals over the slices, one row per slice."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        "_slice",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in columns],
    )


def with_rank(df: DataFrame, *order: Column, name: str = "rn") -> DataFrame:
    """Add the exact 1-based global row number. The order must end in a unique key."""
    rows = sliced(df, *order)
    offsets = _preceding(rows.groupBy("_slice").agg(F.count("*").alias("n")), "n")
    # One row per slice, so the broadcast side is bounded by the partition count.
    return (
        rows.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("n_before") + F.col("_at") + 1)
        .drop("_slice", "_at", "n_before")
    )


def with_running_sum(df: DataFrame, measure: str, *order: Column, name: str) -> DataFrame:
    """Add the row number ``rn`` and the exact running sum up to and including each row.

    NULL amounts add nothing; a sum that has met no amount yet is zero.
    """
    rows = sliced(df, *order)
    offsets = _preceding(
        rows.groupBy("_slice").agg(F.sum(measure).alias("s"), F.count("*").alias("n")), "s", "n"
    )
    inside = F.sum(measure).over(
        Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("s_before") + F.coalesce("_inside", F.lit(0)))
        .withColumn("rn", F.col("n_before") + F.col("_at") + 1)
        .drop("_slice", "_at", "s_before", "n_before", "_inside")
    )


def tier(rank: Column, total: Column, cuts: dict[str, int], rest: str) -> Column:
    """Label by cumulative percent of rows; a partly covered row belongs to the better tier.

    Whole-number arithmetic: ``rank <= ceil(total * p / 100)`` is
    ``(rank - 1) * 100 < total * p``.
    """
    return first_match(
        (((rank - 1) * 100 < total * percent, name) for name, percent in cuts.items()), rest
    )
