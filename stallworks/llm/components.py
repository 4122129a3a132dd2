"""Connected components of an edge table by alternating large and small stars.

Both star steps keep components and move edges towards the smallest id, until every
node points at the smallest id of its component. A node with a third of all edges never
comes to one task: its edges are spread by a hash of their other end, each part is reduced to its
smallest neighbour, the parts to the smallest of all, and that is sent back to every part.
Every round is written to the shared folder, so lineage stays short and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.operators.ranking import written


def _settled(edges: DataFrame) -> bool:
    """Whether every node points at one other, which points nowhere itself.

    Nodes are counted with map-side combining; one row comes to the driver.
    """
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("root"))
    ends = ends.unionAll(edges.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("root").alias("root"))
    return not nodes.agg(F.count_if(F.expr("points > 1 OR points = 1 AND root = 1"))).first()[0]


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The edges with ``m``, the smallest ``other`` of each ``node``."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = edges.withColumn("part", F.pmod(F.xxhash64(other), F.lit(parts)))
    least = (
        spread.groupBy(node, "part")
        .agg(F.min(other).alias("m"))
        .groupBy(node)
        .agg(F.min("m").alias("m"), F.collect_set("part").alias("parts"))
        .select(node, "m", F.explode("parts").alias("part"))
    )
    return spread.join(least, [node, "part"]).drop("part")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    return (
        _with_least(both, "u", "v")
        .where("v > u")
        .select(F.col("v").alias("hi"), F.least("u", "m").alias("lo"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    starred = _with_least(edges, "hi", "lo")
    # The smallest neighbour keeps its edge; the others move to it.
    moved = F.when(F.col("lo") > F.col("m"), F.col("lo")).otherwise(F.col("hi"))
    return starred.select(moved.alias("hi"), F.col("m").alias("lo")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id of ``edges(a, b)``; the component is its smallest id.

    Direction, repeated edges, loops and edges with a NULL end make no difference; an id that
    has only such edges is not returned. An empty table gives an empty result.
    """
    current = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    while not _settled(current):
        current = written(_small_star(_large_star(current)))
    pointed = current.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return pointed.unionAll(roots)
