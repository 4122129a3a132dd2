"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by several fixed Gaussian matrices and decoded
to the nearest point of the E8 lattice, once per table. A vector lives in its own cell and
visits the cells around it (of the 240 neighbours the ones nearest to the projection).
Candidates are a vector and the visitors of its cell. At cosine 0.9 a table finds two thirds of
all pairs and the five tables together all but half a percent; closer pairs are found more often.

Candidates must also nearly agree in 128 sign bits, which costs no transfer and passes
about one in a million unrelated pairs (and loses one in a hundred thousand at 0.9). What passes
is verified by cosine in double precision, see ``linking.linked_components``. Links are then
counted inside each component, in blocks of ``BLOCK`` vectors against blocks, so no pair is ever
a row and no task holds more than two blocks.

Equal vectors are one class with a weight from the start. Defined cases: vectors that are
NULL, empty, zero or hold NULL or non-finite numbers link with nothing; vectors of different
length link with nothing; rows without vec_id link with nothing, have no component and are
kept; rows sharing an id are one vertex, and each of them counts as a vector; input columns
beyond vec_id and embedding are never read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallworks.llm.linking import components_of_ids, linked_components, node_numbers, pairs_across
from stallworks.llm.text import lists, mix, signed
from stallworks.operators.ranking import written

COSINE = 0.9
TABLES = 5
PROBES = 16
CELL = 1.2  # length of a cell's unit in projected space
SIGN_BITS = 128
MOST_SIGNS_APART = 40
BLOCK = 1000

_SEED = 20


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            out.append([a if k == i else b if k == j else 0.0 for k in range(8)])
    halves = np.array(list(itertools.product((0.5, -0.5), repeat=8)))
    even = halves[(halves < 0).sum(axis=1) % 2 == 0]
    return np.vstack([np.array(out), even])


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: round, and mend the worst place if odd."""
    near = np.rint(points)
    error = points - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(error[odd]).argmax(axis=1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_lattice(points: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of its two cosets the nearer one."""
    whole = _nearest_even(points)
    half = _nearest_even(points - 0.5) + 0.5
    nearer = ((points - half) ** 2).sum(axis=1) < ((points - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@lru_cache(maxsize=8)
def _matrices(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([_SEED, dim])
    return rng.normal(size=(tables, dim, 8)), rng.normal(size=(dim, SIGN_BITS))


def _cell_keys(points: np.ndarray, table: int, dim: int) -> np.ndarray:
    key = np.full(points.shape[:-1], (table + 1) * 1_000_003 + dim, dtype=np.uint64)
    doubled = (points * 2).astype(np.int64).view(np.uint64)
    for place in range(8):
        key = mix(key * np.uint64(0xD1342543DE82EF95) + doubled[..., place])
    return key


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Keys of the own cells of all tables, then of the visited ones, a row per vector."""
    dim = unit.shape[1]
    own, visited = [], []
    for table in range(tables):
        projected = unit @ _matrices(dim, tables)[0][table] / CELL
        point = nearest_lattice(projected)
        own.append(_cell_keys(point, table, dim)[:, None])
        if probes:
            toward = (projected - point) @ roots().T
            nearest = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
            around = point[:, None, :] + roots()[nearest]
            visited.append(_cell_keys(around, table, dim))
    return np.hstack(own + visited)


def signs(unit: np.ndarray) -> np.ndarray:
    """Sign bits of fixed projections, as two 64-bit numbers per vector."""
    bits = unit @ _matrices(unit.shape[1], TABLES)[1] >= 0
    return np.packbits(bits, axis=1).view(np.int64)


def _units(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for value in column:
        numbers = value.values
        if numbers is None or len(numbers) == 0 or numbers.null_count:
            out.append(None)
            continue
        vector = numbers.to_numpy(zero_copy_only=False).astype(np.float64)
        length = np.linalg.norm(vector / max(np.abs(vector).max(), 1e-300))
        if not np.isfinite(vector).all() or not vector.any():
            out.append(None)
        else:
            out.append(vector / np.abs(vector).max() / length)
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = TABLES * (1 + PROBES)
    for batch in batches:
        units = _units(batch.column("embedding"))
        n = len(units)
        keys = np.zeros((n, width), dtype=np.uint64)
        bits = np.zeros((n, 2), dtype=np.int64)
        for dim in {len(u) for u in units if u is not None}:
            rows = np.array([i for i, u in enumerate(units) if u is not None and len(u) == dim])
            same = np.stack([units[i] for i in rows])
            keys[rows], bits[rows] = cells(same), signs(same)
        real = np.array([u is not None for u in units], dtype=bool)
        sizes = [0 if u is None else len(u) for u in units]
        flat = np.concatenate([np.zeros(0), *[u for u in units if u is not None]])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"),
                pa.array(
                    [None if u is None else hashlib.blake2b(u, digest_size=16).digest() for u in units],
                    pa.binary(),
                ),
                lists(flat, sizes, pa.float64()),
                lists(signed(keys[real].ravel()), np.where(real, width, 0), pa.int64()),
                pa.array(bits[:, 0]),
                pa.array(bits[:, 1]),
            ],
            ["vec_id", "digest", "unit", "cells", "s0", "s1"],
        )


def _close_pairs(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            len(p.values) == len(q.values) and float(p.values.to_numpy() @ q.values.to_numpy()) >= cosine
            for p, q in zip(batch.column("of_a"), batch.column("of_b"))
        ]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(vectors: DataFrame, cosine: float, pairs: DataFrame) -> DataFrame:
    left = vectors.select(F.col("id").alias("a"), F.col("unit").alias("of_a"))
    right = vectors.select(F.col("id").alias("b"), F.col("unit").alias("of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .mapInArrow(partial(_close_pairs, cosine=cosine), "a long, b long")
    )


def _block_counts(group: pa.Table, cosine: float) -> pa.Table:
    """Links between the vectors of two blocks, or inside one, counted for each vector."""
    ids, weight = group["id"].to_numpy(), group["weight"].to_numpy().astype(np.float64)
    mine, lo, hi = (group[c].to_numpy() for c in ("mine", "lo", "hi"))
    flat = group["unit"].combine_chunks().values.to_numpy()
    unit = flat.reshape(len(ids), -1)
    first, second = mine == lo, mine == hi
    linked = unit[first] @ unit[second].T >= cosine
    if lo[0] == hi[0]:
        np.fill_diagonal(linked, True)
        n = linked @ weight - 1
    else:
        n = np.zeros(len(ids))
        n[first] = linked @ weight[second]
        n[second] = linked.T @ weight[first]
    return pa.table({"id": ids, "n": n.astype(np.int64)})


def _link_counts(nodes: DataFrame, cosine: float, block: int) -> DataFrame:
    """``(id, n_links)`` from ``(component, id, unit, weight)``."""
    sizes = nodes.groupBy("component").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block)
    dealt = (
        nodes.join(sizes, "component")
        .withColumn("blocks", blocks.cast("int"))
        .withColumn("mine", F.expr("CAST(pmod(xxhash64(id), blocks) AS INT)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "component",
            F.least("mine", "other").alias("lo"),
            F.greatest("mine", "other").alias("hi"),
            "mine",
            "id",
            "unit",
            "weight",
        )
    )

    def counts(group: pa.Table) -> pa.Table:
        return _block_counts(group, cosine)

    counted = dealt.groupBy("component", "lo", "hi").applyInArrow(counts, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("n_links"))


def embedding_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row."""
    prepared = written(
        embeddings.select("vec_id", "embedding").mapInArrow(
            _prepared,
            "vec_id long, digest binary, unit array<double>, cells array<long>, s0 long, s1 long",
        )
    )
    named = prepared.where("vec_id IS NOT NULL AND digest IS NOT NULL")
    classes = written(
        node_numbers(
            named.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
        )
    )
    firsts = classes.withColumnsRenamed({"digest": "__digest", "node": "id"})
    chosen = written(
        named.join(
            firsts, (F.col("vec_id") == F.col("rep")) & (F.col("digest") == F.col("__digest"))
        )
        .dropDuplicates(["id"])
        .select("id", "unit", "cells", "s0", "s1", "weight")
    )
    members = chosen.select(
        "id", "s0", "s1", F.posexplode("cells").alias("place", "bucket")
    ).withColumn("own", F.col("place") < TABLES).drop("place")
    near = f"bit_count(x.s0 ^ y.s0) + bit_count(x.s1 ^ y.s1) <= {MOST_SIGNS_APART}"
    verify = partial(_verified, chosen.select("id", "unit"), cosine)
    across = pairs_across(near, "x.own", verify)
    found = linked_components(members, lambda _: (verify, across), near, "x.own")
    nodes = found.join(chosen.select("id", "unit", "weight"), "id")
    counts = _link_counts(nodes, cosine, block)
    ids = named.select(F.col("vec_id").alias("id"), "digest")
    by_class = (
        classes.join(counts.withColumnRenamed("id", "node"), "node", "left")
        .join(components_of_ids(found, classes, ids), "digest")
        .select(
            "digest", "component_id", F.coalesce("n_links", F.col("weight") - 1).alias("n_links")
        )
    )
    digest = F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")
    return (
        prepared.select("vec_id", digest)
        .join(by_class, "digest", "left")
        .withColumn("component_id", F.coalesce("component_id", "vec_id"))
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            "component_id",
            F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )
