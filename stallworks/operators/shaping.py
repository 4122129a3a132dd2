"""Bands, shares, deterministic top-k and exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stallworks.functions.expressions import first_match, pct, ratio

def whole() -> WindowSpec:
    """The window over all rows, for tables that are already reduced to a bounded size."""
    return Window.partitionBy()


def band(
    df: DataFrame, column: str, edges: Sequence, labels: Sequence[str], closed: str = "right"
) -> DataFrame:
    """Add ``band`` and ``band_order``; the last label takes everything past the last edge.

    ``closed='right'`` makes an edge the largest value of its band, ``'left'`` the
    smallest value of the next one.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("a band list needs one label more than edges")
    if closed not in ("right", "left"):
        raise ValueError(f"closed must be 'right' or 'left', not {closed!r}")
    value = F.col(column)
    inside = [(value <= edge) if closed == "right" else (value < edge) for edge in edges]
    position = first_match(
        ((test, i) for i, test in enumerate(inside, start=1)), len(labels)
    ).cast("bigint")
    names = F.array(*[F.lit(label) for label in labels])
    return df.withColumn("band_order", position).withColumn(
        "band", F.element_at(names, F.col("band_order").cast("int"))
    )


def by_band(df: DataFrame, *measures: Column) -> DataFrame:
    """Aggregate a banded table; group on the number, keep the label beside it."""
    return df.groupBy("band_order", "band").agg(*measures)


def share_of_total(df: DataFrame, measure: str, name: str, digits: int = 2) -> DataFrame:
    """Each row's percentage of the column total.

    For tables already reduced to a bounded set (months, states, bands): the window
    has one partition.
    """
    return df.withColumn(name, pct(F.col(measure), F.sum(measure).over(whole()), digits))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows; callers end the order with a key so that ties are settled."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """First k rows of each group; Spark cuts every task to k rows per group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def histogram(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """value -> number of observations, NULL included."""
    seen = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(F.col(value).alias("value")).agg(seen.alias("n")).filter(F.col("n") > 0)


def mean_and_lower_median(hist: DataFrame, mean_name: str, median_name: str, n_name: str) -> DataFrame:
    """Exact mean (one digit), lower median and size from a histogram of day counts.

    The lower median is the value at place ceil(n / 2), where NULLs sort first; the mean
    leaves NULLs out. A histogram of days has some thousand rows however many orders
    there are, so the running count may sit in one partition.
    """
    running = F.sum("n").over(Window.orderBy("value"))
    reached = hist.withColumn("_half", running * 2 >= F.sum("n").over(whole()))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    return reached.agg(
        ratio(F.sum(F.col("value") * F.col("n")), F.sum(known), 1).alias(mean_name),
        F.min(F.when(F.col("_half"), F.col("value"))).cast("double").alias(median_name),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias(n_name),
    )
