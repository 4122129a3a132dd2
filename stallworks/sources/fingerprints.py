"""Per month, sums of row hashes that tell whether rows are still the same.

A part is a name for some columns of a table. Its fingerprint is, per purchase month, the
number of rows and the sum of their hashes: it changes when a row is added, removed, changed
or moved to another month, and does not depend on order or partitioning. Rows are reduced to
their order, or at once to the month where the table is stored by month, before anything is
shuffled; the result has one row per part and month.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.sources.monthly import Month, month_of_purchase
from stallworks.sources.schemas import MONTH, SCHEMAS
from stallworks.sources.tables import Tables

# Columns that a part may take from the parent of its table; a ``has_`` column tells whether
# there is a parent at all.
BORROWED: dict[str, tuple[str, str]] = {
    "product_category_name": ("products", "product_id"),
    "product_category_name_english": ("category_name", "product_category_name"),
    "customer_unique_id": ("customers", "customer_id"),
    "customer_state": ("customers", "customer_id"),
    "customer_city": ("customers", "customer_id"),
    "seller_state": ("sellers", "seller_id"),
    "seller_city": ("sellers", "seller_id"),
    "has_customer": ("customers", "customer_id"),
    "has_product": ("products", "product_id"),
    "has_seller": ("sellers", "seller_id"),
}

Part = tuple[str, tuple[str, ...]]


def whole_table(name: str) -> Part:
    return name, tuple(SCHEMAS[name].names)


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of the row; each column tells whether it is NULL, which the hash itself skips."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _halves(part: str) -> list[Column]:
    """Sums of the upper and the lower 32 bits of hashes: two small numbers instead of a decimal."""
    upper, lower = F.shiftright(part, 32), F.col(part).bitwiseAND(F.lit((1 << 32) - 1))
    return [F.sum(upper).alias(f"_upper_{part}"), F.sum(lower).alias(f"_lower_{part}")]


def _whole(part: str) -> Column:
    """The exact sum of all hashes from sums of their halves."""
    upper, lower = (F.sum(F.col(f"_{half}_{part}").cast("decimal(20,0)")) for half in ("upper", "lower"))
    return (upper.cast("decimal(27,0)") * F.lit(1 << 32).cast("decimal(10,0)") + lower).cast("decimal(38,0)")


def order_month(orders: DataFrame) -> Column:
    return F.col(MONTH) if MONTH in orders.columns else month_of_purchase()


def _borrowed(t: Tables, rows: DataFrame, columns: set[str]) -> DataFrame:
    """The rows with what they lack of the columns, joined once per parent, nearest parent first."""
    missing = columns - set(rows.columns)
    parents: dict[tuple[str, str], list[str]] = {}
    for column in sorted(missing):
        parents.setdefault(BORROWED[column], []).append(column)
    for (parent, key), own in sorted(parents.items(), key=lambda p: p[0][1] in BORROWED):
        if key not in rows.columns:
            rows = _borrowed(t, rows, {key})
        given = [F.lit(True).alias(c) if c.startswith("has_") else F.col(c) for c in own]
        rows = rows.join(t[parent].select(key, *given), key, "left")
    return rows


def _lender(column: str, own: set[str]) -> tuple[str, str]:
    """The parent, and its key among the own columns, through which a column is looked up."""
    parent, key = BORROWED[column]
    return (parent, key) if key in own else _lender(key, own)


def _lent(t: Tables, lender: tuple[str, str], parts: Mapping[str, list[str]]) -> DataFrame:
    """Per row of the parent its key and, for each part, a hash of what the part takes from it."""
    parent, key = lender
    columns = {c for wanted in parts.values() for c in wanted}
    known = t[parent].withColumns(
        {c: F.lit(True) for c in columns if c.startswith("has_") and BORROWED[c][0] == parent}
    )
    rows = _borrowed(t, known, columns)
    return rows.select(key, *[row_hash(wanted).alias(f"_of_{p}") for p, wanted in parts.items()])


def _hashed(t: Tables, table: str, parts: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """``order_id``, the month where the table knows it, and a hash per part.

    Own columns are hashed before, and a parent's columns on its own rows, so that a join moves
    keys and hashes only.
    """
    rows, own = t[table], set(t[table].columns)
    lenders: dict[tuple[str, str], dict[str, list[str]]] = {}
    for part, columns in parts.items():
        for column in columns:
            if column not in own:
                lenders.setdefault(_lender(column, own), {}).setdefault(part, []).append(column)
    month = order_month(rows) if table == "orders" else F.col(MONTH) if MONTH in own else None
    rows = rows.select(
        "order_id" if month is None else month.alias("month"),
        *[F.col(key).alias(f"_{key}") for key in sorted({key for _, key in lenders})],
        *[row_hash([c for c in columns if c in own]).alias(p) for p, columns in parts.items()],
    )
    for lender, wanted in sorted(lenders.items()):
        key = lender[1]
        lent = _lent(t, lender, wanted).withColumnRenamed(key, f"_{key}")
        rows = rows.join(lent, f"_{key}", "left").withColumns(
            {part: row_hash([part, f"_of_{part}"]) for part in wanted}
        )
    return rows


def _of_table(t: Tables, table: str, parts: Mapping[str, tuple[str, ...]]) -> DataFrame:
    rows = _hashed(t, table, parts)
    halves = [half for part in parts for half in _halves(part)]
    if "month" in rows.columns:
        counted = rows.groupBy("month").agg(F.count("*").alias("rows"), *halves)
    else:
        per_order = rows.groupBy("order_id").agg(F.count("*").alias("rows"), *halves)
        months = t["orders"].select("order_id", order_month(t["orders"]).alias("month"))
        counted = per_order.join(months, "order_id", "left")
    by_month = counted.groupBy("month").agg(
        F.sum("rows").alias("rows"), *[_whole(p).alias(p) for p in parts]
    )
    each = [F.struct(F.lit(p).alias("part"), F.col(p).alias("mark")) for p in parts]
    return by_month.select("month", "rows", F.inline(F.array(*each)))


def fingerprints(t: Tables, parts: Mapping[str, Part]) -> DataFrame:
    """``(part, purchase_ym, rows, mark)``; parts of a table that look up the same parents share a scan.

    Parts that need no parent are reduced to months or orders as they are read, before any join.
    """
    passes: dict[tuple[str, frozenset], dict[str, tuple[str, ...]]] = {}
    for part, (table, columns) in parts.items():
        own = set(t[table].columns)
        lenders = frozenset(_lender(c, own) for c in columns if c not in own)
        passes.setdefault((table, lenders), {})[part] = columns
    found = None
    for (table, _), shared in passes.items():
        one = _of_table(t, table, shared)
        found = one if found is None else found.unionByName(one)
    return found.select("part", F.col("month").alias(MONTH), "rows", "mark")


def months_apart_in(now: DataFrame, before: DataFrame) -> DataFrame:
    """``(part, purchase_ym)`` of which the fingerprints differ or only one side has any."""
    ours = now.select("part", F.col(MONTH).alias("month"), "rows", "mark")
    theirs = before.select(
        F.col("part").alias("_part"),
        F.col(MONTH).alias("_month"),
        F.col("rows").alias("_rows"),
        F.col("mark").alias("_mark"),
    )
    same = F.col("rows").eqNullSafe(F.col("_rows")) & F.col("mark").eqNullSafe(F.col("_mark"))
    met = (F.col("part") == F.col("_part")) & F.col("month").eqNullSafe(F.col("_month"))
    month = F.when(F.col("part").isNull(), F.col("_month")).otherwise(F.col("month"))
    return (
        ours.join(theirs, met, "full")
        .filter(~same)
        .select(F.coalesce("part", "_part").alias("part"), month.alias(MONTH))
    )


def different_months(now: DataFrame, before: DataFrame) -> list[Month]:
    """Sorted months in which any part differs: as many as the calendar has, at most."""
    return sorted({r[MONTH] for r in months_apart_in(now, before).collect()}, key=str)
