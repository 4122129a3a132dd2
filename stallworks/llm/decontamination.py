"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A mask looks at six word positions and ignores those between them. The two masks below
together hit every stretch of 13 aligned words in which any two are substituted (all 78
pairs of places are covered) and every 9 to 12 in which any one is; a test enumerates both.
Each hit fixes an alignment of a
document with an item; the aligned words are compared, and the document is contaminated if
13 consecutive aligned words differ in at most two places. Items of 9 to 12 words must align
whole with at most one difference; shorter ones prove nothing and are never matched.

What is shuffled is one word wide: a seed with its document and place, then the words of
documents that were hit and the words that items expect at the aligned places, joined by
document, place and word. No row carries a document, so its length does not matter. Seeds of a
benchmark of up to ``BROADCAST_WORDS`` words, which are counted, reach the documents by
broadcast, those of a larger one by shuffle; all else is the same. Words compare without
regard to A-Z case.

Defined cases: NULL or empty texts match nothing; a NULL doc_id is an id like any other;
a NULL item_id too; rows that share an id share its decision; items that share an id are
matched each and reported as one; input columns
beyond doc_id and text are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallworks.llm.text import lower_ascii, words
from stallworks.operators.ranking import written

MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 2, 4, 7, 8))
WINDOW = 13
MISMATCHES = 2
SHORTEST_ITEM = 9

# Benchmarks up to so many words are broadcast: two seeds of 8 bytes and a place each.
BROADCAST_WORDS = 500_000


def _word_hashes(text: Column) -> Column:
    return F.transform(words(lower_ascii(text)), lambda w: F.xxhash64(w))


def _once(column: Column) -> Column:
    """Made once per row: without the generator, Spark would repeat it for every use below."""
    return F.explode(F.array(column))


def _seeds(hashes: str) -> Column:
    """Of every word of an array, one seed for each mask."""

    def at(place: Column) -> Column:
        return F.array(
            *[
                F.xxhash64(F.lit(number), *[F.get(F.col(hashes), place + p) for p in mask])
                for number, mask in enumerate(MASKS)
            ]
        )

    return F.transform(hashes, lambda _, place: at(place))


def _seeded(df: DataFrame, key: str, hashes: str, at: str) -> DataFrame:
    """``(key, at, seed)`` for each word and mask; seeds reaching past the end are verified away."""
    each = df.select(key, _seeds(hashes).alias("seeds"))
    return each.select(key, F.posexplode("seeds").alias(at, "of_masks")).select(
        key, at, F.explode("of_masks").alias("seed")
    )


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contaminated ``(doc_id, item_id, matched_words)``, one row per document and item.

    ``matched_words`` is the largest number of equal words on one alignment.
    """
    bench = (
        items.select("item_id", _once(_word_hashes(F.col("text"))).alias("item_words"))
        .where(F.size("item_words") >= SHORTEST_ITEM)
        .select("item_words", F.struct("item_id", F.xxhash64("item_words").alias("of_text")).alias("item"))
        .dropDuplicates(["item"])
    )
    bench_size = bench.agg(F.sum(F.size("item_words"))).first()[0] or 0
    small = bench_size <= BROADCAST_WORDS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    ends = F.col("item_at") + min(m[-1] for m in MASKS) < F.col("item_size")
    sizes = bench.select(F.col("item").alias("__item"), F.size("item_words").alias("item_size"))
    seeds = (
        _seeded(bench, "item", "item_words", "item_at")
        .join(sent(sizes), F.col("item") == F.col("__item"))
        .where(ends)
        .select("seed", "item", "item_at")
        .distinct()
    )
    narrow = docs.select(F.struct("doc_id", F.xxhash64("text").alias("of_text")).alias("doc"), "text")
    hashed = narrow.select("doc", _once(_word_hashes(F.col("text"))).alias("doc_words"))
    # Few words are met by a seed; what they align is written and read twice.
    aligned = written(
        _seeded(hashed, "doc", "doc_words", "doc_at")
        .join(sent(seeds), "seed")
        .select("doc", "item", (F.col("doc_at") - F.col("item_at")).alias("shift"))
        .distinct()
    )
    expected = (
        aligned.join(
            bench.select(F.col("item").alias("__item"), F.posexplode("item_words").alias("item_at", "word")),
            F.col("item") == F.col("__item"),
        )
        .withColumn("doc_at", F.col("item_at") + F.col("shift"))
        .drop("__item")
    )
    hit = aligned.select(F.col("doc").alias("__doc")).distinct()
    words_hit = (
        narrow.join(hit, F.col("doc") == F.col("__doc"), "left_semi")
        .dropDuplicates(["doc"])
        .select("doc", F.posexplode(_word_hashes(F.col("text"))).alias("doc_at", "word"))
    )
    item_width = F.least(F.lit(WINDOW), F.col("item_size"))
    needed = F.col("width") - F.floor(F.col("width") * MISMATCHES / WINDOW).cast("int")
    # As many equal places as are needed lie within the width.
    close = F.exists(
        F.sequence(F.lit(0), F.greatest(F.size("equal") - F.col("needed"), F.lit(0))),
        lambda i: F.get("equal", i + F.col("needed") - 1) - F.get("equal", i) < F.col("width"),
    )
    return (
        expected.join(words_hit, ["doc", "doc_at", "word"])
        .groupBy("doc", "item", "shift")
        .agg(F.sort_array(F.collect_list("item_at")).alias("equal"))
        .join(sizes, F.col("item") == F.col("__item"))
        .withColumn("width", item_width)
        .withColumn("needed", needed)
        .where((F.size("equal") >= F.col("needed")) & close)
        .groupBy("doc.doc_id", "item.item_id")
        .agg(F.max(F.size("equal")).cast("long").alias("matched_words"))
    )


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage of any item, unchanged."""
    found = overlaps(docs, items).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__found")), "left_anti")
