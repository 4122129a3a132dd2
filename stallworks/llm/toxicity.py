"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Tokens are runs of letters with A-Z lower-cased. Voters are induced from a bounded sample of
labelled rows: lexicon voters fire on a whole token, pattern voters on the first four to six
bytes of a longer token; both are picked for occurring in toxic rows far more often than
chance allows. A voter that does not fire abstains from "toxic". Features are counted on the
executors; the driver receives the picked ones and which rows hold them, whatever the length
of the texts.

The label model treats the true class as hidden. Expectation maximisation estimates how
often each voter fires in either class, and from the votes that the classes leave unexplained the
correlations of voters; a voter's log-odds are divided by one plus its correlations, so
that overlapping patterns do not count several times. The given label is one more voter,
with a fixed reliability. Its posterior labels train a logistic classifier over the same
tokens and patterns plus some that speak for the clean class; the classifier alone
scores documents, in Arrow batches, over whole texts.

Defined cases: NULL is an empty text, and texts without tokens get the score of the
intercept; without labels, or with one class only, the score is the share of toxic rows (0
if there are none); repeated rows are scored each; input columns named like an output
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.llm.sampling import labelled_sample
from stallworks.llm.text import NOT_LETTER, lists, mix, span_hashes, spans, text_blocks
from stallworks.operators.ranking import written

FIT_ROWS = 8_000
VOTERS = 400
CLEAN_FEATURES = 50
PATTERN_BYTES = (4, 5, 6)
LEAST_ROWS = 3  # toxic rows a voter must occur in
LEAST_Z = 3.5  # standard errors by which its rate must exceed the clean rate
LABEL_TRUST = 0.97  # reliability of a given label as a voter
THRESHOLD = 0.3
RIDGE = 0.1

_ROUNDS = 25


@dataclass
class Model:
    """Feature ids in order with their weights; ``lookup`` marks their low 16 bits."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float

    def lookup(self) -> np.ndarray:
        table = np.zeros(1 << 16, dtype=bool)
        table[self.features & 0xFFFF] = True
        return table


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, row of each) of all tokens, then of all patterns of each length."""
    starts, lengths, before = spans(data, offsets, NOT_LETTER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    yield (span_hashes(data, starts, lengths, lower=True) >> np.uint64(32)).astype(np.uint32), row
    for n in PATTERN_BYTES:
        long = np.flatnonzero(lengths > n)
        cut = span_hashes(data, starts[long], np.full(len(long), n), lower=True)
        yield (mix(cut + np.uint64(n)) >> np.uint64(32)).astype(np.uint32), row[long]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in text_blocks(batch.column("text")):
            n = len(offsets) - 1
            ids, rows = (np.concatenate(x) for x in zip(*_features(data, offsets)))
            pairs = np.unique((rows.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64))
            counts = np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=n)
            values = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k").slice(row, n),
                    batch.column("toxic").slice(row, n),
                    lists(values, counts, pa.int32()),
                ],
                ["k", "toxic", "ids"],
            )


def _chosen(sample: DataFrame, n_hit: int, n_miss: int) -> tuple[np.ndarray, np.ndarray]:
    """Voter features and clean features, by the difference of their rates in standard errors."""
    counted = (
        sample.select((F.col("toxic") > 0).cast("long").alias("hit"), F.explode("ids").alias("id"))
        .groupBy("id")
        .agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))
    )
    hits, misses = F.col("hits"), F.col("misses")
    rate = (hits + misses + 1) / (n_hit + n_miss + 2)
    error = F.sqrt(rate * (1 - rate) * (1 / n_hit + 1 / n_miss))
    # Written, as both picks below read the counts.
    z = written(
        counted.select(
            F.expr("pmod(CAST(id AS BIGINT), 4294967296)").alias("id"),
            "hits",
            "misses",
            ((hits / n_hit - misses / n_miss) / error).alias("z"),
        )
    )
    often = (hits >= LEAST_ROWS) & (hits / n_hit > 3 * misses / n_miss)
    good = z.where((F.col("z") >= LEAST_Z) & often)
    least = z.where(F.col("z") < -LEAST_Z)

    def first(rows: DataFrame, order, n: int) -> np.ndarray:
        return np.array([r.id for r in rows.orderBy(order, "id").limit(n).collect()], dtype=np.uint32)

    voters = first(good, F.col("z").desc(), VOTERS)
    return voters, np.setdiff1d(first(least, F.col("z"), CLEAN_FEATURES), voters)


def _matrix(ids: np.ndarray, rows: np.ndarray, n: int, features: np.ndarray) -> np.ndarray:
    out = np.zeros((n, len(features)), dtype=np.float32)
    order = np.argsort(features)
    at = np.searchsorted(features[order], ids)
    at[at == len(features)] = 0
    if len(features):
        same = features[order][at] == ids
        out[rows[same], order[at[same]]] = 1
    return out


def label_posterior(votes: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of toxic per row, dampening of each voter) of the generative label model.

    ``votes`` is rows by voters, 1 where a voter fires; ``given`` holds the labels. The label is
    a voter that cannot be outvoted by silence, only by voters that fire.
    """
    trust = np.log(LABEL_TRUST / (1 - LABEL_TRUST))
    posterior = np.where(given > 0, LABEL_TRUST, 1 - LABEL_TRUST)
    damp = np.ones(votes.shape[1])
    for round_ in range(_ROUNDS):
        mass, rest = posterior.sum(), (1 - posterior).sum()
        fires = (posterior @ votes + 0.5) / (mass + 1)
        errs = ((1 - posterior) @ votes + 0.5) / (rest + 1)
        if round_ in (1, 5):
            left = votes - (posterior[:, None] * fires + (1 - posterior[:, None]) * errs)
            spread = np.sqrt((left**2).sum(axis=0)) + 1e-9
            shared = np.clip((left / spread).T @ (left / spread), 0, 1)
            shared[shared < 0.1] = 0  # sampling noise
            damp = 1 / np.maximum(shared.sum(axis=0), 1)
        on = np.log(fires / errs) * damp
        off = np.log((1 - fires) / (1 - errs)) * damp
        prior = np.log(mass / rest)
        odds = prior + votes @ (on - off) + off.sum()
        # Voters inform rows by what they say beyond the class share; the label adds its trust.
        odds = odds + np.where(given > 0, trust, -trust)
        updated = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(updated - posterior).max() < 1e-6:
            break
        posterior = updated
    return posterior, damp


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by damped Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    penalty = np.full(design.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(design.shape[1])
    share = np.clip(target.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - target) + penalty * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9)
        move = np.linalg.solve(curve, slope)
        w -= move / max(1.0, np.abs(move).max() / 2)
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(
    ids: np.ndarray, rows: np.ndarray, toxic: np.ndarray, voters: np.ndarray, clean: np.ndarray
) -> Model:
    """A classifier from the rows' labels and the sparse ``(feature, row)`` pairs of the features."""
    n = len(toxic)
    posterior, _ = label_posterior(_matrix(ids, rows, n, voters).astype(np.float64), toxic)
    features = np.concatenate([voters, clean])
    weights, intercept = logistic(_matrix(ids, rows, n, features), posterior)
    order = np.argsort(features)
    return Model(features[order], weights[order], intercept)


def fitted(texts: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    # Written, as counts and votes both read it.
    sample = written(
        labelled_sample(texts, labels, "toxic", fit_rows)
        .select(F.xxhash64("doc_id").alias("k"), "text", F.col("toxic").cast("int"))
        .mapInArrow(_sampled, "k long, toxic int, ids array<int>")
    )
    n, n_hit = sample.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    if n_hit in (0, n):
        share = np.clip(n_hit / n if n else 0.0, 1e-9, 1 - 1e-9)
        return Model(np.zeros(0, dtype=np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    voters, clean = _chosen(sample, n_hit, n - n_hit)
    features = np.concatenate([voters, clean]).view(np.int32).tolist()
    picked = F.lit(features) if features else F.lit([]).cast("array<int>")
    votes = (
        sample.select("k", "toxic", F.array_intersect("ids", picked).alias("ids"))
        .toPandas()
        .sort_values(["k", "toxic"], kind="stable")
    )
    toxic = (votes["toxic"].to_numpy() > 0).astype(np.float64)
    each = [np.asarray(x, dtype=np.int32).view(np.uint32) for x in votes["ids"]]
    rows = np.repeat(np.arange(len(each)), [len(x) for x in each])
    return fit(np.concatenate(each), rows, toxic, voters, clean)


def scores(data: np.ndarray, offsets: np.ndarray, model: Model, lookup: np.ndarray) -> np.ndarray:
    """Probability of toxic for each text of a block."""
    n, size = len(offsets) - 1, len(model.features)
    odds = np.full(n, model.intercept)
    if size and len(data):
        found = []
        for ids, rows in _features(data, offsets):
            maybe = np.flatnonzero(lookup[ids & np.uint32(0xFFFF)])
            at = np.minimum(np.searchsorted(model.features, ids[maybe]), size - 1)
            same = model.features[at] == ids[maybe]
            found.append(rows[maybe[same]] * size + at[same])
        pairs = np.unique(np.concatenate(found))
        odds += np.bincount(pairs // size, weights=model.weights[pairs % size], minlength=n)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _scored(model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        lookup = m.lookup()
        for batch in batches:
            out = np.empty(batch.num_rows)
            for row, data, offsets in text_blocks(batch.column("__text")):
                out[row : row + len(offsets) - 1] = scores(data, offsets, m, lookup)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))],
                [*kept, "score", "predicted"],
            )

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, keep_text: bool = False
) -> DataFrame:
    """Columns of ``docs`` with ``score`` (probability of toxic) and ``predicted``.

    ``labels`` has ``doc_id`` and ``toxic``; only its rows that are in ``docs`` are learned
    from. ``text`` is returned only if asked for.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_rows))
    replaced = ("score", "predicted", "__text", *(() if keep_text else ("text",)))
    kept = [c for c in docs.columns if c not in replaced]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    rows = docs.select(*kept, F.col("text").alias("__text"))
    return rows.mapInArrow(_scored(model, kept), schema)
