"""Quality classifier: a byte-level convolutional network in numpy.

Filters of ``WIDTH`` bytes slide over every byte of the document. A filter is a table of one
weight per place and byte value, so a convolution is a sum of table rows. Activations are
max-pooled over overlapping chunks; the chunk maxima are combined over the document by their
mean and their maximum, and a small dense layer turns these into one probability. Scoring
covers whole documents of any length, piece by piece. Training takes gradients through the
maxima only, which touch one window per chunk and filter.

Fitted on the driver from a bounded sample of labelled rows: about ``FIT_ROWS`` rows and
``FIT_BYTES`` bytes at most, of which each document is read whole; documents longer than a 64th
of the bytes teach nothing. Weights are a few hundred kilobytes and are broadcast.

Defined cases: NULL is an empty text; a text shorter than a filter is padded with zero bytes
and scored like any other; without labels, or with one class only, the score is the share of
good rows (0 if there are none); repeated rows are scored each; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.llm.sampling import labelled_sample
from stallworks.llm.text import text_blocks

FILTERS = 16
WIDTH = 5
HIDDEN = 16
HALF_CHUNK = 128  # chunks are two halves long and start at every half
FIT_ROWS = 4_000
FIT_BYTES = 64 << 20
EPOCHS = 6
BATCH = 32
RATE = 0.01
THRESHOLD = 0.3

_PIECE = HALF_CHUNK * 64

Weights = dict[str, np.ndarray]


def initial(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    return {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, dtype=np.float32),
        "dense": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(np.float32),
        "dense_bias": np.zeros(HIDDEN, dtype=np.float32),
        "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "out_bias": np.zeros(1, dtype=np.float32),
    }


def _halves(data: np.ndarray, w: Weights, places: bool):
    """Filter maxima of every half chunk (and where they are, if asked)."""
    if len(data) < WIDTH:
        data = np.concatenate([data, np.zeros(WIDTH - len(data), dtype=np.uint8)])
    windows = len(data) - WIDTH + 1
    best, where = [], []
    size = min(_PIECE, windows)
    sums, term = np.empty((2, size, FILTERS), dtype=np.float32)
    for start in range(0, windows, _PIECE):
        n = min(_PIECE, windows - start)
        total = sums[:n]
        for place in range(WIDTH):
            into = term[:n] if place else total
            symbols = data[start + place : start + place + n]
            np.take(w["table"][place], symbols, axis=0, out=into, mode="clip")
            if place:
                total += into
        full = n - n % HALF_CHUNK
        cuts = [total[:full].reshape(-1, HALF_CHUNK, FILTERS)] if full else []
        if full < n:
            cuts.append(total[None, full:])
        at = start
        for cut in cuts:
            best.append(cut.max(axis=1))
            if places:
                firsts = at + HALF_CHUNK * np.arange(len(cut))[:, None]
                where.append(cut.argmax(axis=1) + firsts)
            at += full
    return np.concatenate(best), np.concatenate(where) if places else None, data


def _pooled(halves: np.ndarray, w: Weights) -> np.ndarray:
    """Mean and maximum over overlapping chunks of the rectified chunk maxima."""
    chunks = np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves
    chunks = np.maximum(chunks + w["bias"], 0)
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def _head(pooled: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ w["out"] + w["out_bias"][0], -30, 30)))


def probability(data: np.ndarray, w: Weights) -> float:
    halves, _, _ = _halves(data, w, places=False)
    return float(_head(_pooled(halves, w), w)[1])


def _gradients(batch: list[np.ndarray], target: np.ndarray, w: Weights) -> Weights:
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    for data, y in zip(batch, target):
        halves, where, padded = _halves(data, w, places=True)
        if len(halves) > 1:
            later = halves[1:] > halves[:-1]
            raw = np.where(later, halves[1:], halves[:-1])
            where = np.where(later, where[1:], where[:-1])
        else:
            raw = halves
        chunks = np.maximum(raw + w["bias"], 0)
        top = chunks.argmax(axis=0)
        pooled = np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])
        hidden, p = _head(pooled, w)
        slope = (p - y) / len(batch)
        grads["out"] += slope * hidden
        grads["out_bias"] += slope
        d_hidden = slope * w["out"] * (hidden > 0)
        grads["dense"] += np.outer(pooled, d_hidden)
        grads["dense_bias"] += d_hidden
        d_pooled = w["dense"] @ d_hidden
        d_chunks = np.repeat(d_pooled[None, :FILTERS] / len(chunks), len(chunks), axis=0)
        d_chunks[top, np.arange(FILTERS)] += d_pooled[FILTERS:]
        d_chunks *= chunks > 0
        grads["bias"] += d_chunks.sum(axis=0)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for place in range(WIDTH):
            np.add.at(grads["table"][place], (padded[where + place], filters), d_chunks)
    return grads


def fit(texts: list[bytes], good: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Weights:
    """Adam over small batches in a fixed shuffled order."""
    w = initial(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            picked = order[at : at + BATCH]
            grads = _gradients([data[i] for i in picked], good[picked], w)
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                w[k] -= (rate * first[k] / (1 - 0.9**step) / scale).astype(np.float32)
    return w


def fitted(
    texts: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES
) -> Weights | float:
    """Weights, or a constant probability where there is nothing to tell apart."""
    rows = (
        labelled_sample(texts, labels, "quality", fit_rows, fit_bytes)
        .select(F.xxhash64("doc_id").alias("k"), "text", "quality")
        .toPandas()
        .sort_values(["k", "quality", "text"], kind="stable")
    )
    good = rows["quality"].to_numpy(dtype=np.float32)
    if len(good) == 0 or good.min() == good.max():
        return float(good.mean()) if len(good) else 0.0
    return fit([(t or "").encode() for t in rows["text"]], good)


def _scored(model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for row, data, offsets in text_blocks(batch.column("__text")):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]]
                    scores[row + i] = w if isinstance(w, float) else probability(text, w)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                [*kept, "score", "predicted"],
            )

    return run


def quality_scores(
    docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES
) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``score`` (probability of good) and ``predicted``.

    ``labels`` has ``doc_id`` and ``quality``; only its rows that are in ``docs`` are learned from.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, fit_rows, fit_bytes))
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted", "__text")]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    rows = docs.select(*kept, F.col("text").alias("__text"))
    return rows.mapInArrow(_scored(model, kept), schema)
