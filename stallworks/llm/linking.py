"""Components of similar rows from candidate buckets, without all pairs of a bucket.

First every row of a bucket is compared with the bucket's leader. Links found so join rows
into components. Only buckets that still hold several components can hide a link that
matters; their rows are compared across components, never within one. No bucket is capped, so
every candidate pair is verified, already connected, or ruled out by the caller's filter.

Tables of leaders and of open buckets are written before they are joined: the join then
shuffles both sides anew, and adaptive execution can split a hot bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.llm.components import components
from stallworks.operators.ranking import written

# Takes (a, b) id pairs and returns those that are linked.
Verify = Callable[[DataFrame], DataFrame]

# Takes rows (bucket, x, lead, component) of open buckets, ``lead`` being the id of the bucket's
# leader, and returns the linked (a, b) pairs of different components that share a bucket.
Across = Callable[[DataFrame], DataFrame]


def pairs_across(filters: str, home: str, verify: Verify) -> Across:
    """Pairs that pass the filter, then the check."""

    def across(left: DataFrame) -> DataFrame:
        right = left.select("bucket", F.col("x").alias("y"), F.col("component").alias("other"))
        one_home = F.expr(home) | F.expr(home.replace("x.", "y."))
        apart = left.join(right, "bucket").where(
            F.expr("x.id < y.id AND component <> other") & one_home & F.expr(filters)
        )
        return verify(
            apart.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        )

    return across


def linked_components(
    members: DataFrame,
    prepare: Callable[[DataFrame], tuple[Verify, Across]],
    filters: str = "true",
    home: str = "true",
    central: bool = False,
) -> DataFrame:
    """``(id, component)`` of every id that is linked to another.

    ``members`` holds ``(bucket, id, ...)`` of all buckets. ``prepare`` is given the ids that may
    be in a pair and returns the checks of pairs with a leader and of pairs without one.
    ``filters`` is a condition over the columns of two rows ``x`` and ``y`` that linked pairs
    meet. ``home`` is a condition over one row ``x``: only such rows lead. With ``central``
    leaders are the rows that share most buckets with most rows, the centre of a family of
    copies, and else the smallest ids.
    """
    rest = [c for c in members.columns if c != "bucket"]
    rows = members.select("bucket", F.struct(*rest).alias("x"))
    sizes = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.max(F.expr(home).cast("int")).alias("led")
    )
    sizes = written(sizes.where("n > 1 AND led = 1").select("bucket", "n"))
    shared = rows.join(sizes, "bucket")
    if central:
        shared = written(shared)
        weights = written(
            shared.groupBy(F.col("x.id").alias("__id")).agg((-F.sum("n")).alias("order"))
        )
        shared = shared.join(weights, F.col("x.id") == F.col("__id")).drop("__id")
    else:
        shared = shared.withColumn("order", F.lit(0))
    shared = written(shared.drop("n"))
    first_of = F.min(F.when(F.expr(home), F.struct("order", "x")))
    leaders = written(
        shared.groupBy("bucket").agg(first_of.alias("lead")).select("bucket", F.col("lead.x").alias("y"))
    )
    led = written(shared.drop("order").join(leaders, "bucket"))
    verify, across = prepare(led.select("x.id").distinct())
    stars = led.where("x.id <> y.id")
    first = written(
        verify(
            stars.where(filters).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        )
    )
    found = components(first)

    named = found.withColumnRenamed("id", "__id")
    placed = written(
        stars.select("bucket", "x", F.col("y.id").alias("lead"))
        .join(named, F.col("x.id") == F.col("__id"), "left")
        .withColumn("component", F.coalesce("component", "x.id"))
        .drop("__id")
    )
    # Leaders have been compared with everyone, so buckets are open among the others.
    still_open = written(
        placed.groupBy("bucket")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where("least < most")
        .select("bucket")
    )
    second = written(across(written(placed.join(still_open, "bucket", "left_semi"))))
    if second.isEmpty():
        return found
    return components(first.unionAll(second))


def node_numbers(classes: DataFrame) -> DataFrame:
    """``classes(digest, rep, ...)`` with ``node``, a number that no two classes share.

    The smallest id of a class is its number, unless classes begin with the same id; all but one
    of these are numbered by a hash of the digest, anew until no number occurs twice.
    """
    place = F.row_number().over(Window.partitionBy("rep").orderBy("digest"))
    placed = written(classes.withColumn("place", place))
    salt = 0
    while True:
        other = F.xxhash64(F.lit(salt), "digest")
        numbered = placed.withColumn("node", F.when(F.col("place") == 1, F.col("rep")).otherwise(other))
        if numbered.groupBy("node").count().where("count > 1").isEmpty():
            return numbered.drop("place")
        salt += 1


def components_of_ids(
    found: DataFrame, classes: DataFrame, rows: DataFrame
) -> DataFrame:
    """``(digest, component_id)``: the smallest id that a class reaches.

    ``found(id, component)`` joins classes by links, ``classes(digest, rep, node)`` names them, and
    ``rows(id, digest)`` are all rows: an id of several classes joins them too.
    """
    spread = rows.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    spread = written(spread.where("least < most").select(F.col("id").alias("__id"), "least"))
    if not spread.isEmpty():
        names = classes.select("digest", "node")
        same_id = (
            rows.join(spread, F.col("id") == F.col("__id"))
            .join(names.withColumnsRenamed({"digest": "__d", "node": "b"}), F.col("least") == F.col("__d"))
            .join(names.withColumnRenamed("node", "a"), "digest")
            .select("a", "b")
        )
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(same_id))
    joined = classes.join(found.withColumnRenamed("id", "node"), "node", "left").select(
        "digest", "rep", F.coalesce("component", "node").alias("component_id")
    )
    if classes.where("node <> rep").isEmpty():
        return joined.drop("rep")
    # A number made from a hash may be the least of its component; the least id is asked for.
    least = joined.groupBy("component_id").agg(F.min("rep").alias("least_id"))
    return joined.join(least, "component_id").select("digest", F.col("least_id").alias("component_id"))
