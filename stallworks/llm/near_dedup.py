"""MinHash near-duplicates with SuperMinHash signatures.

A document's set is its distinct k-word shingles. SuperMinHash gives every element one random
permutation of the signature's slots; in step j the element offers slot number j of its
permutation a value between j and j + 1, and a slot keeps its least offer. Steps end as
soon as every slot holds less than the next step could offer, which for most documents is
after one or two. Signatures are cut into bands of ``ROWS`` slots: with 24 bands of 4, a pair at
similarity 0.8 shares no band with probability 3e-6.

Equal sets (128-bit digest) are one class from the start and only their smallest id is banded.
Rows sharing a band are linked by ``linking.linked_components``; each link is confirmed on
the full sets of 64-bit shingle hashes, built again from the text for candidates only. Pairs
without a bucket's leader are confirmed by their differences from it, which are short in
a family of copies: sets x and y differ in as many shingles as their differences from the
leader do, so the condition is exact and only links leave the join. Components are found by
union over the confirmed links (large and small stars).

Defined cases: NULL and empty texts have an empty set and are linked with nothing; texts with
fewer than k words have their whole sequence as one shingle; rows without doc_id are linked
with nothing, have no component and are kept; rows sharing an id are one document in
the graph, linked if any of their texts is; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.llm.linking import components_of_ids, linked_components, node_numbers
from stallworks.llm.text import grams, lists, mix, signed, span_hashes, spans, text_blocks
from stallworks.operators.ranking import written

SHINGLE_WORDS = 5
PERCENT = 80
BANDS = 24
ROWS = 4

_U64 = np.uint64


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document, from its word hashes."""
    if len(hashes) < k:
        k = len(hashes)
    return np.unique(grams(hashes, k, seed=k)) if k else hashes[:0]


def super_minhash(elements: np.ndarray, owner: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """Signatures (docs by slots) of many sets at once; ``owner`` is the set of each element.

    A slot holds step and fraction as one 64-bit number: the step above 32 bits of fraction.
    """
    signature = np.full(docs * slots, np.iinfo(np.uint64).max, dtype=_U64)
    order = None
    for step in range(slots):
        if step:
            worst = signature.reshape(docs, slots).max(axis=1) >> _U64(32)
            going = worst[owner] >= step
            if not going.any():
                break
            elements, owner = elements[going], owner[going]
            if order is None:
                kind = np.uint8 if slots <= 256 else np.uint16
                order = np.empty((len(elements), slots), dtype=kind)
                order[:] = np.arange(slots, dtype=kind)
                rows = np.arange(len(elements))
                order[rows, slot[going]] = 0
                order[:, 0] = slot[going]
            else:
                order = order[going]
            rows = np.arange(len(elements))
        chance = mix(elements + _U64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        low = chance & _U64(0xFFFFFFFF)
        pick = (step + ((low * _U64(slots - step)) >> _U64(32))).astype(np.int64)
        if step == 0:
            slot = pick
        else:
            slot = order[rows, pick].astype(np.int64)
            order[rows, pick] = order[:, step]
            order[:, step] = slot
        offer = _U64(step << 32) | (chance >> _U64(32))
        np.minimum.at(signature, owner * slots + slot, offer)
    return signature.reshape(docs, slots)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = signature.reshape(len(signature), bands, rows)
    total = np.broadcast_to(np.arange(bands, dtype=_U64) + _U64(1), cut.shape[:2]).copy()
    for row in range(rows):
        total = mix(total * _U64(0xD1342543DE82EF95) + cut[:, :, row])
    return total


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, data, offsets in text_blocks(column):
        starts, lengths, before = spans(data, offsets)
        hashes = span_hashes(data, starts, lengths, lower=True)
        yield row, [shingles(hashes[a:b], k) for a, b in zip(before[:-1], before[1:])]


def _digests(sets: list[np.ndarray]) -> list[bytes | None]:
    return [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]


def _signed(
    batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in _sets(batch.column("text"), k):
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            signature = super_minhash(np.concatenate(sets), owner, len(sets), bands * rows)
            keys = band_hashes(signature, bands, rows)[sizes > 0]
            digests = _digests(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(sets)),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    lists(signed(keys.ravel()), np.where(sizes > 0, bands, 0), pa.int64()),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, sets in _sets(batch.column("text"), k):
            sizes = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(sets)),
                    pa.array(_digests(sets), pa.binary()),
                    lists(signed(np.concatenate(sets)), sizes, pa.int64()),
                ],
                ["id", "digest", "elements"],
            )


def _confirmed(sets: DataFrame, percent: int, pairs: DataFrame) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("of_a") + F.size("of_b") - both))
        .select("a", "b")
    )


def _across(sets: DataFrame, percent: int, rows: DataFrame) -> DataFrame:
    """Links between components of a bucket, from differences to its leader."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("of_b"))
    pairs = rows.select(F.col("x.id").alias("a"), F.col("lead").alias("b")).distinct()
    apart = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    differences = written(
        pairs.join(left, "a").join(right, "b").select("a", "b", apart.alias("apart"))
    )
    x = written(
        rows.join(differences, (F.col("x.id") == F.col("a")) & (F.col("lead") == F.col("b"))).select(
            "bucket",
            F.struct("x.id", "x.n_shingles", "component", "apart", F.size("apart").alias("n")).alias("x"),
        )
    )
    y = x.withColumnRenamed("x", "y")
    sizes = "(x.n_shingles + y.n_shingles)"

    def within(differing: str) -> str:
        return f"100 * ({sizes} - {differing}) >= {percent} * ({sizes} + {differing})"

    # Two differences cannot be closer than their sizes are; most pairs end there.
    between = "(x.n + y.n - 2 * size(array_intersect(x.apart, y.apart)))"
    linked = x.join(y, "bucket").where(
        F.expr("x.id < y.id AND x.component <> y.component")
        & F.expr(within("abs(x.n - y.n)"))
        & F.expr(within(between))
    )
    return linked.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    k: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row of ``docs``."""
    narrow = docs.select("doc_id", "text")
    signatures = written(
        narrow.mapInArrow(
            partial(_signed, k=k, bands=bands, rows=rows),
            "doc_id long, n_shingles long, digest binary, bands array<long>",
        )
    )
    named = signatures.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(node_numbers(named.groupBy("digest").agg(F.min("doc_id").alias("rep"))))
    chosen = named.join(
        classes.withColumnsRenamed({"digest": "__digest"}),
        (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("__digest")),
    )
    members = chosen.select(
        F.explode("bands").alias("bucket"), F.col("node").alias("id"), "n_shingles"
    )
    # Texts of classes that begin with the same id are told apart by their digests.
    several = written(classes.groupBy("rep").count().where("count > 1").select("rep"))
    apart = not several.isEmpty()

    def prepare(ids: DataFrame):
        plain = ids
        if apart:
            plain = ids.join(several, F.col("id") == F.col("rep"), "left_anti")
        wanted = narrow.join(plain, F.col("doc_id") == F.col("id"), "left_semi")
        columns = "id long, digest binary, elements array<long>"
        sets = wanted.mapInArrow(partial(_set_rows, k=k), columns).drop("digest")
        if apart:
            shared = narrow.join(several, F.col("doc_id") == F.col("rep"), "left_semi")
            named_sets = shared.mapInArrow(partial(_set_rows, k=k), columns).join(
                classes.select("rep", "node", F.col("digest").alias("__digest")),
                (F.col("id") == F.col("rep")) & (F.col("digest") == F.col("__digest")),
            )
            wanted_sets = named_sets.select(F.col("node").alias("id"), "elements")
            sets = sets.unionAll(wanted_sets.join(ids, "id", "left_semi").dropDuplicates(["id"]))
        sets = written(sets)
        return partial(_confirmed, sets, percent), partial(_across, sets, percent)

    close = f"least(x.n_shingles, y.n_shingles) * 100 >= {percent} * greatest(x.n_shingles, y.n_shingles)"
    found = linked_components(members, prepare, close, central=True)
    rows_of = named.select(F.col("doc_id").alias("id"), "digest")
    by_class = components_of_ids(found, classes, rows_of)
    return (
        signatures.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
        .join(by_class, "digest", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def deduplicated(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays, the one with the smallest id, unchanged.

    Rows sharing an id stay or go together.
    """
    gone = (
        near_duplicates(docs, k, percent)
        .where("NOT kept")
        .select(F.col("doc_id").alias("__gone"))
        .distinct()
    )
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
