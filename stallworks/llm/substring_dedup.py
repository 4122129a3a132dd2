"""Substring deduplication by relative Lempel-Ziv parsing.

The references of a document are all documents with a smaller id, indexed in blocks of
``WINDOW`` consecutive words. Parsing goes from left to right: a factor starts at the first
place whose block a reference holds and grows word by word while the block one further is the
next one of the same reference; a factor is thus a copy of one stretch of one reference, at least
``WINDOW`` words long, and each of its ends is a place where that was checked and failed. Where
another reference goes on, the next factor starts; where none does, words are literal. The words
of all factors are the duplicate spans: just those of the blocks that some reference holds.

The index is sparse without losing a match. A block is represented by the least hash among its
runs of ``GRAM`` words; equal blocks have equal representatives, and neighbouring blocks mostly
share theirs. Only representatives met in several documents can belong to a repeated block. The
neighbouring blocks of one place of a representative are a stretch, about twenty blocks, and
stretches are looked up first, by 96 bits of hash, reduced on the map side to the first
document and place that holds them. A stretch that a reference holds needs no more; stretches
inside copies do not depend on what surrounds the copy, so most are settled here. Single blocks are
looked up, in the same way, only of the first document that holds a stretch: where copies begin
and end. A passage in a third of all documents leaves one row per task.

Exact copies are settled by a digest of all words and only the smallest id is parsed on. Tables
that later steps do not read any more are deleted on the way.

Defined cases: NULL and empty texts have no words and keep the hash of an empty text; texts
shorter than a window are never cut; rows without doc_id neither cut nor are cut; rows
sharing an id do not cut each other; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.llm.scratch import discard
from stallworks.llm.text import (
    grams,
    lists,
    mix,
    signed,
    sliding_min,
    span_hashes,
    spans,
    text_blocks,
)
from stallworks.operators.ranking import written

WINDOW = 50
GRAM = 8

_U64 = np.uint64


def representatives(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Representative of the block at every place where a whole block fits."""
    return sliding_min(grams(hashes, gram, seed=gram), window - gram + 1)


def block_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 more bits for the block at every place, by running sums."""
    n = len(hashes) - window + 1
    if n <= 0:
        return hashes[:0], np.zeros(0, dtype=np.int32)
    # Doubling: the hash of 2m words from two of m words, then the rest of the window.
    keys = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        reach, level = 1, mix(hashes ^ _U64(seed))
        levels = {1: level}
        while reach * 2 <= window:
            level = mix(level[:-reach] * _U64(seed | 1) + level[reach:])
            reach *= 2
            levels[reach] = level
        total, at = np.zeros(n, dtype=_U64), 0
        for size in sorted(levels, reverse=True):
            if at + size <= window:
                total = mix(total * _U64(seed | 1) + levels[size][at : at + n])
                at += size
        keys.append(total)
    return keys[0], (keys[1] >> _U64(32)).astype(np.uint32).view(np.int32)


def stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every run of equal values."""
    if not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def factors(at: np.ndarray, n: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, window: int) -> list:
    """``(start, words, reference, place in it)`` from found stretches of blocks, by place."""
    place = np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    source = np.repeat(ref, n)
    shift = np.repeat(ref_at - at, n)
    # A factor goes on while the next block is the next block of the same reference.
    goes_on = (np.diff(place) == 1) & (np.diff(source) == 0) & (np.diff(shift) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))[: len(place)]
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    return [
        (int(place[i]), int(place[j] - place[i]) + window, int(source[i]), int(place[i] + shift[i]))
        for i, j in zip(first, last)
    ]


def covered(parsed: list, n_words: int) -> np.ndarray:
    """Words inside a factor."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    for start, words, _, _ in parsed:
        change[start] += 1
        change[start + words] -= 1
    return np.cumsum(change[:-1]) > 0


def _hashed(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    for row, data, offsets in text_blocks(column):
        starts, lengths, before = spans(data, offsets)
        hashes = span_hashes(data, starts, lengths)
        yield row, [hashes[a:b] for a, b in zip(before[:-1], before[1:])], data, offsets


def _kept_hash(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _profiled(
    batches: Iterator[pa.RecordBatch], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """Of every document: words, hash of the normalised text, digest and representatives."""
    for batch in batches:
        for row, texts, data, offsets in _hashed(batch.column("text")):
            marks = [np.unique(representatives(h, window, gram)) for h in texts]
            whole = [
                _kept_hash(data[a:b].tobytes().split()) for a, b in zip(offsets[:-1], offsets[1:])
            ]
            digests = [
                hashlib.blake2b(h, digest_size=16).digest() if len(h) >= window else None
                for h in texts
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(row, len(texts)),
                    batch.column("text_key").slice(row, len(texts)),
                    pa.array([len(h) for h in texts], pa.int64()),
                    pa.array(whole, pa.string()),
                    pa.array(digests, pa.binary()),
                    lists(signed(np.concatenate(marks)), [len(m) for m in marks], pa.int64()),
                ],
                ["doc_id", "text_key", "n_words", "whole_sha256", "digest", "marks"],
            )


def _of_rows(batch: pa.RecordBatch, rows: list[int], counts: list[int]) -> list[pa.Array]:
    """The keys of some rows, each repeated."""
    take = pa.array(np.repeat(rows, counts).astype(np.int64))
    return [batch.column(name).take(take) for name in ("doc_id", "text_key")]


def _stretches(
    batches: Iterator[pa.RecordBatch], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """Stretches of blocks whose representative is in several documents, with their places."""
    for batch in batches:
        shared = batch.column("marks")
        for row, texts, _, _ in _hashed(batch.column("text")):
            keys, rows, counts = [], [], []
            for i, hashes in enumerate(texts):
                known = shared[row + i].values.to_numpy(zero_copy_only=False).view(np.uint64)
                marks = representatives(hashes, window, gram)
                at, n = stretches(marks)
                here = np.isin(marks[at], known)
                at, n = at[here], n[here]
                if not len(at):
                    continue
                # All blocks of a stretch, in order, and their number make its hash.
                high, low = block_hashes(hashes, window)
                sums = [np.append(_U64(0), np.cumsum(mix(x))) for x in (high, low.astype(_U64))]
                order = np.arange(len(high), dtype=_U64)
                turned = np.append(_U64(0), np.cumsum(mix(high) * order))
                total = sums[0][at + n] - sums[0][at]
                total_low = sums[1][at + n] - sums[1][at]
                places = turned[at + n] - turned[at] - total * at.astype(_U64)
                wide = mix(total ^ mix(places + n.astype(_U64)))
                narrow = mix(total_low + places) >> _U64(32)
                keys.append((signed(wide), narrow.astype(np.uint32).view(np.int32), at, n))
                rows.append(row + i)
                counts.append(len(at))
            if keys:
                high, low, at, n = map(np.concatenate, zip(*keys))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high), pa.array(low), *_of_rows(batch, rows, counts),
                     pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["high", "low", "doc_id", "text_key", "at", "n"],
                )


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The single blocks of the stretches that are asked for."""
    for batch in batches:
        asked = batch.column("asked")
        for row, texts, _, _ in _hashed(batch.column("text")):
            for i, hashes in enumerate(texts):
                own = asked[row + i].values
                start, n = [own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n")]
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                high, low = block_hashes(hashes, window)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(high[at])), pa.array(low[at]),
                     *_of_rows(batch, [row + i], [len(at)]), pa.array(at.astype(np.int32))],
                    ["high", "low", "doc_id", "text_key", "at"],
                )


_FACTOR = pa.struct(
    [("start", pa.int32()), ("words", pa.int32()), ("ref_id", pa.int64()), ("ref_start", pa.int32())]
)


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Parse each document into factors, cut them out and join what is left by single spaces."""
    for batch in batches:
        removed, left, parses = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found")):
            words = text.encode().split()
            columns = [
                found.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("at", "n", "ref_id", "ref_at")
            ]
            order = np.argsort(columns[0])
            parsed = factors(*[c[order] for c in columns], window)
            gone = covered(parsed, len(words))
            removed.append(int(gone.sum()))
            left.append([w for w, g in zip(words, gone) if not g])
            parses.append([dict(zip(("start", "words", "ref_id", "ref_start"), f)) for f in parsed])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(removed, pa.int64()),
                pa.array([_kept_hash(w) for w in left], pa.string()),
                pa.array([b" ".join(w).decode() for w in left], pa.string()),
                pa.array(parses, pa.list_(_FACTOR)),
            ],
            ["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text", "factors"],
        )


def _text_key():
    """Tells rows apart that share an id."""
    return F.xxhash64("text")


def _first_holders(rows: DataFrame) -> DataFrame:
    """Keys held by several documents, with the first document and place that holds them.

    Written, so that a join with it shuffles both sides anew and can split a hot key.
    """
    return written(
        rows.groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most"))
        .where("first.doc_id < most")
        .select("high", "low", F.col("first.doc_id").alias("ref_id"), F.col("first.at").alias("ref_at"))
    )


def _cuts(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Profile of every row with the first id of its exact copies, and what parsing cuts."""
    narrow = docs.select("doc_id", "text", _text_key().alias("text_key"))
    profile = written(
        narrow.mapInArrow(
            partial(_profiled, window=window, gram=gram),
            "doc_id long, text_key long, n_words long, whole_sha256 string, digest binary,"
            " marks array<long>",
        )
    )
    long = profile.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    firsts = written(long.groupBy("digest").agg(F.min("doc_id").alias("first_id")))
    marks = long.join(
        firsts.withColumnRenamed("digest", "__digest"),
        (F.col("doc_id") == F.col("first_id")) & (F.col("digest") == F.col("__digest")),
        "left_semi",
    ).select("doc_id", "text_key", F.explode("marks").alias("mark"))
    several = (
        marks.groupBy("mark")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .where("least < most")
        .select("mark")
    )
    shared = (
        marks.join(several, "mark", "left_semi")
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set("mark").alias("marks"))
    )
    # The only rows of which the text is needed again; repeated rows once.
    suspects = written(narrow.join(shared, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]))
    pieces = written(
        suspects.mapInArrow(
            partial(_stretches, window=window, gram=gram),
            "high long, low int, doc_id long, text_key long, at int, n int",
        )
    )
    holders = _first_holders(pieces)
    held = F.coalesce(F.col("ref_id") < F.col("doc_id"), F.lit(False))
    placed = written(
        pieces.join(holders, ["high", "low"], "left")
        .withColumn("held", held)
        .select("doc_id", "text_key", "held", "at", "n", "ref_id", "ref_at")
    )
    discard(pieces, holders)
    asked = (
        placed.where(~F.col("held"))
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("at", "n")).alias("asked"))
    )
    blocks = written(
        suspects.drop("marks")
        .join(asked, ["doc_id", "text_key"])
        .mapInArrow(
            partial(_blocks, window=window),
            "high long, low int, doc_id long, text_key long, at int",
        )
    )
    index = _first_holders(blocks)
    single = (
        blocks.join(index, ["high", "low"])
        .where("ref_id < doc_id")
        .select("doc_id", "text_key", "at", F.lit(1).alias("n"), "ref_id", "ref_at")
    )
    found = (
        placed.where("held")
        .select(single.columns)
        .unionAll(single)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_list(F.struct("at", "n", "ref_id", "ref_at")).alias("found"))
    )
    cut = written(
        suspects.drop("marks")
        .join(found, ["doc_id", "text_key"])
        .mapInArrow(
            partial(_parsed, window=window),
            "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string,"
            " factors array<struct<start: int, words: int, ref_id: long, ref_start: int>>",
        )
    )
    discard(suspects, placed, blocks, index)
    rows = profile.drop("marks").join(firsts, "digest", "left").drop("digest")
    copies = rows.withColumn("is_copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False)))
    return copies, cut


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row."""
    rows, cut = _cuts(docs, window, gram)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(cut.drop("kept_text", "factors"), ["doc_id", "text_key"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("is_copy"), F.col("n_words"))
        .otherwise(F.coalesce("n_removed", F.lit(0)))
        .alias("n_removed"),
        F.when(F.col("is_copy"), nothing)
        .otherwise(F.coalesce("kept_sha256", "whole_sha256"))
        .alias("kept_sha256"),
    )


def copied_factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, words, ref_id, ref_start)``: factors in words from 0, in every document.

    A document that is an exact copy is one factor of the first of its copies.
    """
    rows, cut = _cuts(docs, window, gram)
    whole = rows.where("is_copy").select(
        "doc_id",
        F.lit(0).alias("start"),
        F.col("n_words").cast("int").alias("words"),
        F.col("first_id").alias("ref_id"),
        F.lit(0).alias("ref_start"),
    )
    return cut.select("doc_id", F.inline("factors")).unionAll(whole.distinct())


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents with repeated spans cut from ``text``; untouched texts stay as they are.

    All rows stay, also those of which nothing is left.
    """
    rows, cut = _cuts(docs, window, gram)
    emptied = rows.where("is_copy").select("doc_id", "text_key", F.lit("").alias("kept_text"))
    changed = (
        cut.select("doc_id", "text_key", "kept_text")
        .unionAll(emptied.distinct())
        .withColumnsRenamed({"doc_id": "__id", "text_key": "__key", "kept_text": "__text"})
    )
    return docs.join(
        changed, (F.col("doc_id") == F.col("__id")) & (_text_key() == F.col("__key")), "left"
    ).select(
        *[
            F.coalesce("__text", "text").alias("text") if name == "text" else F.col(name)
            for name in docs.columns
        ]
    )
