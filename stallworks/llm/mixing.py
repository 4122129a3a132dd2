"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue of its documents in shuffled order, repeated ``repeats`` times. A
document's virtual finish time is the number of words its source has offered up to and
including it, over the source's target. Served in order of finish time, all sources are
near the same fraction of their targets at any moment, so cutting the global order at the
word budget leaves each within about a document of its target.

Defined cases: a NULL source is a source of its own, last in order; NULL and empty texts have
no words, wait at time zero and take nothing; rows that agree in id, source and size are
served together, as often as each other; without any words every target is zero. The
shuffle hashes the document id, so reruns agree; ties of the hash fall to id and size.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.llm.text import word_count
from stallworks.operators.ranking import with_running_sum

WEIGHTS = (5, 2, 1)
BUDGET_PERCENT = 150
REPEATS = 2
SHUFFLE_SEED = "mix"

_WIDE = "decimal(20,0)"


def source_targets(
    sources: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
) -> DataFrame:
    """Targets of ``(source, source_size)`` rows, one per source.

    Sources by code point take the weights in turn. Going up in cap per weight, a source is
    full if serving it and every later one at its own cap per weight stays in the budget;
    the rest share by weight what the full ones leave. Windows run over one row per source.
    Adds ``target``, ``before`` (words of earlier sources) and ``budget`` (in hundredths).
    """
    everything = Window.partitionBy()
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "place")
    ranked = (
        sources.withColumn("place", F.row_number().over(by_code_point))
        .withColumn(
            "before", F.sum("source_size").over(by_code_point) - F.col("source_size")
        )
        .withColumn("budget", F.sum("source_size").over(everything) * budget_percent)
        .withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(w).cast("long") for w in weights]),
                (F.col("place") - 1) % len(weights) + 1,
            ),
        )
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn(
            "full_before",
            F.coalesce(
                F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .withColumn(
            "weight_on", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
        )
    )
    full = (
        F.col("cap").cast(_WIDE) * F.col("weight_on").cast("decimal(16,0)")
        + F.col("full_before").cast(_WIDE) * F.col("weight").cast("decimal(16,0)")
    ) * 100 <= F.col("budget").cast(_WIDE) * F.col("weight").cast("decimal(16,0)")
    shared = ranked.withColumn("full", full).withColumns(
        {
            "full_words": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything),
            "open_weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(
                everything
            ),
        }
    )
    left = (F.col("budget") - 100 * F.col("full_words")) * F.col("weight")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        left.cast("double") / (100 * F.col("open_weight")).cast("double")
    )
    return shared.select("source", "source_size", "before", "budget", target.alias("target"))


def fair_mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget_percent: int = BUDGET_PERCENT,
    repeats: int = REPEATS,
) -> DataFrame:
    """Every document with ``size``, ``source_size``, ``target`` and ``times`` it is taken."""
    units = (
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .groupBy("doc_id", "source", "size")
        .agg(F.count("*").alias("rows"))
        .withColumn("words", F.col("size") * F.col("rows"))
        .withColumn(
            "turn",
            F.md5(F.concat(F.lit(SHUFFLE_SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
        )
    )
    targets = source_targets(
        units.groupBy("source").agg(F.sum("words").alias("source_size")),
        weights,
        budget_percent,
        repeats,
    ).withColumnRenamed("source", "of_source")
    queued = with_running_sum(
        units,
        "words",
        F.col("source").asc_nulls_last(),
        F.col("turn"),
        F.col("doc_id"),
        F.col("size"),
        name="offered",
    ).drop("rn", "turn", "rows")
    served = F.col("offered") - F.col("before") + F.col("pass") * F.col("source_size")
    entries = (
        queued.join(targets, F.col("source").eqNullSafe(F.col("of_source")))
        .drop("of_source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn(
            "finish", F.when(F.col("target") > 0, served / F.col("target")).otherwise(F.lit(0.0))
        )
    )
    order = ("finish", "source", "pass", "offered", "doc_id", "size")
    spent = with_running_sum(entries, "words", *[F.col(c) for c in order], name="spent")
    taken = (
        spent.groupBy("doc_id", "source", "size", "source_size", "target")
        .agg(
            F.sum((100 * F.col("spent") <= F.col("budget")).cast("long")).alias("times")
        )
        .withColumnsRenamed({"doc_id": "__doc_id", "source": "__source", "size": "__size"})
    )
    own = ("size", "source_size", "target", "times")
    kept = [c for c in docs.columns if c not in own]
    return (
        docs.select(*kept)
        .withColumn("size", word_count(F.col("text")))
        .join(
            taken,
            F.col("doc_id").eqNullSafe(F.col("__doc_id"))
            & F.col("source").eqNullSafe(F.col("__source"))
            & (F.col("size") == F.col("__size")),
        )
        .select(*kept, *own)
    )
