"""Check jobs that stand in for database constraints: keys, references, NULLs, domains.

Each check returns one row per rule with the number of offending rows, so a clean
warehouse reports zeros. Offending keys are counted, never collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, required_columns
from stallworks.sources.tables import Tables


def stacked(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def surplus_keys(df: DataFrame, *keys: str) -> DataFrame:
    """How many keys repeat, and how many rows a unique key would have rejected."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("surplus_rows"),
        )
    )


def primary_key_check(t: Tables) -> DataFrame:
    return stacked(
        [
            surplus_keys(t[name], *PRIMARY_KEYS[name]).select(
                F.lit(name).alias("tbl"),
                F.lit(",".join(PRIMARY_KEYS[name])).alias("key_columns"),
                "repeated_keys",
                "surplus_rows",
            )
            for name in t.present()
        ]
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose reference is missing; children are counted per reference first."""
    references = (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_ref"))
        .agg(F.count("*").alias("n"))
    )
    known = parent.select(F.col(parent_key).alias("_ref"))
    return references.join(known, "_ref", "left_anti").agg(
        F.count("*").alias("missing_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"),
    )


def foreign_key_check(t: Tables) -> DataFrame:
    loaded = set(t.present())
    return stacked(
        [
            orphans(
                t[ref.child], ref.column, t[ref.parent], PRIMARY_KEYS[ref.parent][0]
            ).select(
                F.lit(ref.label).alias("reference"),
                F.lit(ref.parent).alias("parent"),
                "missing_keys",
                "orphan_rows",
            )
            for ref in FOREIGN_KEYS
            if {ref.child, ref.parent} <= loaded
        ]
    )


def _counted(df: DataFrame, table: str, rules: dict[str, Column], count_name: str) -> DataFrame:
    """Evaluate all rules of a table in one pass, one output row per rule."""
    totals = df.agg(*[F.count_if(test).alias(f"r{i}") for i, test in enumerate(rules.values())])
    entries = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias(count_name))
            for i, rule in enumerate(rules)
        ]
    )
    return totals.select(F.lit(table).alias("tbl"), F.inline(entries))


def not_null_check(t: Tables) -> DataFrame:
    return stacked(
        [
            _counted(
                t[name],
                name,
                {column: F.col(column).isNull() for column in required_columns(name)},
                "null_rows",
            )
            for name in t.present()
        ]
    )


def domain_check(t: Tables, lowest_score: int = 1, highest_score: int = 5) -> DataFrame:
    def negative(column: str) -> dict[str, Column]:
        return {f"{column} < 0": F.col(column) < 0}

    rules = {
        "order_items": negative("price") | negative("freight_value"),
        "order_payments": negative("payment_value"),
        "order_reviews": {
            "review_score out of range": ~F.col("review_score").between(
                lowest_score, highest_score
            )
        },
    }
    loaded = t.present()
    return stacked(
        [
            _counted(t[name], name, tests, "bad_rows")
            for name, tests in rules.items()
            if name in loaded
        ]
    )
