"""Source divergence audit: how the words of a source differ from those of other sources.

First pass: the number of documents of every (lang, term), counted exactly by the term itself, which
leaves the kept vocabulary. It is cut into shards by a hash of the term, and each shard becomes
a minimal perfect hash that also stores its keys. Second pass: the shards are broadcast, and every
task increments dense arrays, one per group and shard, at the slots of the terms it meets; a
term that is no stored key counts nowhere. Only the filled slots leave a task.

One broadcast holds about ``ROUND_BYTES`` of shards at most. A larger vocabulary takes several
rounds, each of which reads the documents again, so memory does not grow with the corpus.

From the counts on, blocks of slots are independent: a block holds the counts of all groups of
a language for a bounded number of terms, and gives a share of every pair's divergence and the
candidates for every group's list of terms. All arithmetic is on whole numbers; scaled shares
are divided in three steps, which stays below 64 bits for up to 9 * 10^15 occurrences.

Defined cases: NULL text, lang and source are empty strings; an empty table has no rows; a
document without terms still makes its group occur; a language without kept terms gives pairs
of value 0 and no terms; repeated rows are documents of their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallworks.llm.perfect_hash import PerfectHash, perfect_hash, string_hashes
from stallworks.llm.terms import COUNT_BLOCK_BYTES, encoded, runs
from stallworks.llm.text import signed, text_blocks
from stallworks.operators.ranking import written

MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE_STEP, SCALE_STEPS = 1000, 3  # shares are scaled by 10^9

SHARD_KEYS = 1 << 15
# A shard holds somewhat more or fewer keys than that; its slots stay below this.
_STRIDE_BITS = 24
ROUND_BYTES = 48 << 20
# Dense arrays of a task are emptied into rows when they have grown to so many slots.
_HELD_SLOTS = 8 << 20
# Cells (groups times terms) of a block in the last step.
_BLOCK_CELLS = 1 << 18

_U64 = np.uint64

Kept = dict[str, tuple[int, dict[int, PerfectHash]]]


def scaled_share(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``floor(10^9 * counts / total)`` exactly, for ``counts <= total``."""
    out, rest = np.zeros(np.broadcast(counts, total).shape, dtype=np.int64), counts
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        out = out * SCALE_STEP + rest // total
        rest = rest % total
    return out


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per (lang, term), block by block."""
    for batch in batches:
        row_lang, langs = encoded(batch.column("lang"))
        for row, data, offsets in text_blocks(batch.column("text"), COUNT_BLOCK_BYTES):
            found, _, rows = runs(data, offsets)
            codes, terms = encoded(found)
            met = np.unique(rows * len(terms) + codes)
            if not len(met):
                continue
            lang = row_lang[row + met // len(terms)]
            cells, n = np.unique(lang * len(terms) + met % len(terms), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(pa.array(cells // len(terms))),
                    terms.take(pa.array(cells % len(terms))),
                    pa.array(n, pa.int64()),
                ],
                ["lang", "term", "n_docs"],
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column("term")
        yield batch.append_column("hash", pa.array(signed(string_hashes(terms))))


def _built(group: pa.Table) -> pa.Table:
    """One shard: its keys in slot order and the arrays of its perfect hash."""
    made = perfect_hash(group.column("term").combine_chunks())
    return pa.table(
        {
            "lang": group.column("lang").slice(0, 1),
            "part": group.column("part").slice(0, 1),
            "parts": group.column("parts").slice(0, 1),
            "n_bytes": pa.array([made.keys.nbytes + made.words.nbytes + made.before.nbytes]),
            "sizes": pa.array([made.sizes], pa.list_(pa.int64())),
            "words": pa.array([made.words.tobytes()], pa.binary()),
            "before": pa.array([made.before.tobytes()], pa.binary()),
            "keys": pa.array([made.keys.to_pylist()], pa.list_(pa.string())),
        }
    )


_SHARD = (
    "lang string, part long, parts long, n_bytes long, sizes array<long>, words binary,"
    " before binary, keys array<string>"
)


def vocabulary(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, n_docs)`` of the terms that enough documents of a language hold."""
    counted = _columns(docs).mapInArrow(_document_counts, "lang string, term string, n_docs long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"))
    return kept.where(F.col("n_docs") >= min_documents)


def _shards(docs: DataFrame, min_documents: int, shard_keys: int) -> DataFrame:
    kept = written(
        vocabulary(docs, min_documents)
        .select("lang", "term")
        .mapInArrow(_hashed, "lang string, term string, hash long")
    )
    # As many parts for every language as the largest one needs.
    largest = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    parts = F.lit(-(-largest // shard_keys)).cast("long").alias("parts")
    parted = kept.select("lang", "term", "hash", parts).withColumn(
        "part", F.expr("pmod(shiftright(hash, 8), parts)")
    )
    return written(parted.groupBy("lang", "part").applyInArrow(_built, _SHARD))


def _part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (hashes.view(np.int64) >> 8) % parts


def _loaded(rows) -> Kept:
    kept: Kept = {}
    for r in rows:
        made = PerfectHash(
            list(r["sizes"]),
            np.frombuffer(r["words"], dtype=_U64),
            np.frombuffer(r["before"], dtype=np.int64),
            pa.array(r["keys"], pa.string()),
        )
        kept.setdefault(r["lang"], (r["parts"], {}))[1][r["part"]] = made
    return kept


def _filled(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source, part), counts in held.items():
        slots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(len(slots), np.int64))),
                pa.array([source], pa.string()).take(pa.array(np.zeros(len(slots), np.int64))),
                pa.array((part << _STRIDE_BITS) + slots),
                pa.array(counts[slots]),
            ],
            ["lang", "source", "slot", "n"],
        )


def _recounted(shards: Broadcast):
    """Occurrences per group and slot, added up in dense arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Kept = shards.value
        held: dict[tuple[str, str, int], np.ndarray] = {}
        for batch in batches:
            row_lang, langs = encoded(batch.column("lang"))
            row_source, sources = encoded(batch.column("source"))
            groups, row_group = np.unique(row_lang * len(sources) + row_source, return_inverse=True)
            for row, data, offsets in text_blocks(batch.column("text"), COUNT_BLOCK_BYTES):
                found, _, rows = runs(data, offsets)
                codes, terms = encoded(found)
                cells, n = np.unique(row_group[row + rows] * len(terms) + codes, return_counts=True)
                hashes = string_hashes(terms)
                group_ends = np.searchsorted(cells, np.arange(len(groups) + 1) * len(terms))
                for g, (a, b) in enumerate(zip(group_ends[:-1], group_ends[1:])):
                    lang = langs[groups[g] // len(sources)].as_py()
                    if a == b or lang not in kept:
                        continue
                    source = sources[groups[g] % len(sources)].as_py()
                    parts, by_part = kept[lang]
                    mine = cells[a:b] - g * len(terms)
                    part = _part_of(hashes[mine], parts)
                    order = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[order], np.arange(parts + 1))
                    for p, made in by_part.items():
                        here = order[ends[p] : ends[p + 1]]
                        slots = made.slots(terms.take(pa.array(mine[here])), hashes[mine[here]])
                        counts = held.get((lang, source, p))
                        if counts is None:
                            counts = held[lang, source, p] = np.zeros(len(made.keys), dtype=np.int64)
                        counts[slots[slots >= 0]] += n[a:b][here[slots >= 0]]
                if sum(map(len, held.values())) > _HELD_SLOTS:
                    yield from _filled(held)
                    held.clear()
        yield from _filled(held)

    return run


def _slot_counts(docs: DataFrame, shards: DataFrame, round_bytes: int) -> DataFrame:
    """``(lang, source, slot, n)`` of all rounds."""
    spark = docs.sparkSession
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    rounds = max(1, -(-total // round_bytes))
    turn = F.pmod(F.xxhash64("lang", "part"), F.lit(rounds))
    counted = None
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(_loaded(shards.where(turn == r).collect()))
        found = (
            _columns(docs)
            .mapInArrow(_recounted(sent), "lang string, source string, slot long, n long")
            .groupBy("lang", "source", "slot")
            .agg(F.sum("n").alias("n"))
        )
        found = written(found)
        sent.unpersist()
        counted = found if counted is None else counted.unionAll(found)
    return counted


def _block_figures(
    members: pa.StructArray, v: int, cells: pa.StructArray, top: int
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of one block: the slots, the pairs' shares, and per group the places and values of its terms."""
    sizes = members.field("total").to_numpy(zero_copy_only=False)
    group = pc.index_in(cells.field("source"), value_set=members.field("source"))
    slots, at = np.unique(cells.field("slot").to_numpy(zero_copy_only=False), return_inverse=True)
    counts = np.zeros((len(sizes), len(slots)), dtype=np.int64)
    counts[group.to_numpy(zero_copy_only=False), at] = cells.field("n").to_numpy(zero_copy_only=False)
    p = 1 + scaled_share(counts + 1, (sizes + v)[:, None])
    q = 1 + scaled_share(counts.sum(0) + 1, sizes.sum() + v)
    pairs = np.stack([((own - p) ** 2 // p).sum(1) for own in p])
    places, values = [], []
    for own, n in zip(p, counts):
        more = np.flatnonzero((n > 0) & (own > q))
        value = (own[more] - q[more]) ** 2 // q[more]
        if len(more) > top:
            # Ties with the last place stay; the terms themselves settle them later.
            least = np.partition(value, -top)[-top]
            more, value = more[value >= least], value[value >= least]
        places.append(more)
        values.append(value)
    return slots, pairs, places, values


def _figures(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            members, cells = batch.column("members")[i].values, batch.column("cells")[i].values
            lang, sources = batch.column("lang")[i].as_py(), members.field("source")
            slots, pairs, places, values = _block_figures(
                members, batch.column("v")[i].as_py(), cells, top
            )
            s = len(sources)
            own, other = np.divmod(np.arange(s * s), s)
            apart = own != other
            of_term = np.repeat(np.arange(s), [len(x) for x in places])
            n = int(apart.sum()) + len(of_term)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * n, pa.string()),
                    sources.take(pa.array(np.concatenate([own[apart], of_term]))),
                    pa.array(
                        sources.take(pa.array(other[apart])).to_pylist() + [None] * len(of_term),
                        pa.string(),
                    ),
                    pa.array([None] * int(apart.sum()) + slots[np.concatenate(places)].tolist(), pa.int64()),
                    pa.array(np.concatenate([pairs.ravel()[apart], *values]), pa.int64()),
                ],
                ["lang", "source", "item", "slot", "value"],
            )


def source_divergence(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    top: int = TOP_TERMS,
    shard_keys: int = SHARD_KEYS,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by divergence, terms by excess."""
    shards = _shards(docs, min_documents, shard_keys)
    cells = _slot_counts(docs, shards, round_bytes)
    groups = _columns(docs).select("lang", "source").distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    member = F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))
    kept = shards.groupBy("lang").agg(F.sum(F.size("keys")).cast("long").alias("v"))
    langs = written(
        groups.join(totals, ["lang", "source"], "left")
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(member)).alias("members"))
        .join(kept, "lang", "left")
        .withColumn("v", F.coalesce("v", F.lit(0)))
    )
    most = langs.agg(F.max(F.size("members"))).first()[0] or 1
    bits = max(4, int(_BLOCK_CELLS // most).bit_length() - 1)
    blocks = (
        cells.withColumn("block", F.shiftright("slot", bits))
        .groupBy("lang", "block")
        .agg(F.collect_list(F.struct("source", "slot", "n")).alias("cells"))
        .join(langs, "lang")
    )
    figures = written(
        blocks.select("lang", "members", "v", "cells").mapInArrow(
            lambda batches: _figures(batches, top),
            "lang string, source string, item string, slot long, value long",
        )
    )
    # Every pair of a language has a value in each block, so a language without terms adds its own.
    empty = (
        langs.where("v = 0")
        .select("lang", F.explode("members.source").alias("source"), F.col("members.source").alias("of"))
        .select("lang", "source", F.explode("of").alias("item"), F.lit(0).cast("long").alias("value"))
        .where("item <> source")
    )
    pairs = (
        figures.where("item IS NOT NULL")
        .select("lang", "source", "item", "value")
        .unionAll(empty)
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("part", F.lit("pair"))
    )
    names = shards.select("lang", "part", F.posexplode("keys").alias("at", "item")).select(
        "lang", (F.shiftleft("part", _STRIDE_BITS) + F.col("at")).alias("slot"), "item"
    )
    terms = figures.where("slot IS NOT NULL").drop("item").join(names, ["lang", "slot"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = F.row_number().over(order).alias("rank")
    return (
        pairs.select("*", ranked)
        .select(columns)
        .unionAll(
            terms.select("*", ranked, F.lit("term").alias("part")).where(F.col("rank") <= top).select(columns)
        )
    )
