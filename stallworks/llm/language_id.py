"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are read as code points, with A-Z lower-cased and every ASCII character that is no letter as
a space. Runs of three and four characters are hashed into a fixed number of bins. Counts of a
bounded sample are summed by Spark into one matrix (languages by bins) of smoothed
log-probabilities, which is broadcast. Texts are scored in groups: the bin counts of a group are
one sparse matrix (texts by bins), which is multiplied with the log-probabilities at once. Long texts
are cut into pieces whose counts add up.

The sample has about ``FIT_ROWS`` rows at most; of more than ``LANGUAGES`` languages in it those
with most texts are learned, which bounds the matrix.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0, as is every
text if nothing could be learned; rows without a language teach nothing; equal posteriors go to
the language that sorts first; repeated rows are judged each; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallworks.llm.sampling import bounded_sample
from stallworks.llm.text import NOT_LETTER, mix, text_blocks
from stallworks.operators.ranking import written

BINS = 1 << 14
SMOOTHING = 0.1
FIT_ROWS = 20_000
LANGUAGES = 256

UNKNOWN = "und"

# Texts of one group, and bytes of texts that are worked on together.
_GROUP_ROWS = 1024
# Bin counts of so few texts are kept dense while they are counted.
_DENSE_ROWS = 64
_GROUP_BYTES = 1 << 18
_TASK_LANGUAGES = 64

_SYMBOLS = np.arange(128, dtype=np.uint32)
_SYMBOLS[ord("A") : ord("Z") + 1] += 32
_SYMBOLS[NOT_LETTER[:128]] = 0x20


def code_points(data: np.ndarray) -> np.ndarray:
    """Characters of UTF-8 bytes, those of ASCII as a lower-case letter or a space."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, _SYMBOLS[np.minimum(codes, 127)], codes)


def gram_bins(codes: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the three and of the four characters that begin at each place."""
    wide = codes.astype(np.uint64)
    if len(wide) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    three = mix(wide[:-2] | wide[1:-1] << np.uint64(21) | wide[2:] << np.uint64(42))
    four = mix(three[:-1] ^ (wide[3:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    cut = np.uint64(bins)
    return (three % cut).astype(np.int64), (four % cut).astype(np.int64)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text cut between characters into pieces of about ``_GROUP_BYTES`` bytes."""
    start = 0
    while start < len(data):
        stop = min(start + _GROUP_BYTES, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        yield data[start:stop]
        start = stop


def _long_counts(data: np.ndarray) -> np.ndarray:
    """Bin counts of one text of any length; neighbouring pieces share three characters."""
    counts = np.zeros(BINS, dtype=np.int64)
    space = np.array([0x20], dtype=np.uint32)
    carried = space
    for piece in _pieces(data):
        codes = np.concatenate([carried, code_points(piece)])
        three, four = gram_bins(codes)
        # The first three characters of a later piece have been counted.
        counts += np.bincount(three[int(len(carried) == 3) :], minlength=BINS)
        counts += np.bincount(four, minlength=BINS)
        carried = codes[-3:]
    three, four = gram_bins(np.concatenate([carried, space]))
    counts += np.bincount(three[int(len(carried) == 3) :], minlength=BINS)
    return counts + np.bincount(four, minlength=BINS)


# Of a group of texts: the text, the bin and its count, by text and bin.
Sparse = tuple[np.ndarray, np.ndarray, np.ndarray]


def _group_counts(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    """Bin counts of the texts of a group, all in one pass, a space before and after each."""
    rows = len(offsets) - 1
    codes = code_points(data)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    row = np.repeat(np.arange(rows), np.diff(begins) + 2)
    padded = np.full(len(row), 0x20, dtype=np.uint32)
    inside = np.arange(len(codes)) + 1 + 2 * np.repeat(np.arange(rows), np.diff(begins))
    padded[inside] = codes
    cells = []
    for n, found in zip((3, 4), gram_bins(padded)):
        first = row[: len(found)]
        same = first == row[n - 1 : n - 1 + len(found)]
        cells.append(first[same] * BINS + found[same])
    cells = np.concatenate(cells)
    if rows <= _DENSE_ROWS:
        counts = np.bincount(cells)
        used = np.flatnonzero(counts)
        return used // BINS, used % BINS, counts[used]
    used, counts = np.unique(cells, return_counts=True)
    return used // BINS, used % BINS, counts


def bin_counts(column: pa.Array) -> Iterator[tuple[int, int, Sparse]]:
    """(first row, rows, sparse counts) of consecutive groups of texts."""
    for row, data, offsets in text_blocks(column, _GROUP_BYTES):
        if len(offsets) == 2 and len(data) > _GROUP_BYTES:
            counts = _long_counts(data)
            used = np.flatnonzero(counts)
            yield row, 1, (np.zeros(len(used), dtype=np.int64), used, counts[used])
            continue
        for at in range(0, len(offsets) - 1, _GROUP_ROWS):
            part = offsets[at : at + _GROUP_ROWS + 1]
            yield row + at, len(part) - 1, _group_counts(data[part[0] : part[-1]], part - part[0])


def _emitted(counts: dict[str, np.ndarray], texts: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for lang, row in counts.items():
        used = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * (len(used) + 1), pa.string()),
                pa.array(np.append(used, -1)),
                pa.array(np.append(row[used], texts[lang])),
            ],
            ["lang", "bin", "n"],
        )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bin counts of the labelled texts of one task by language, and at bin -1 its texts."""
    counts: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for row, rows, (text, found, n) in bin_counts(batch.column("text")):
            ends = np.searchsorted(text, np.arange(rows + 1))
            for i in range(rows):
                lang, own = langs[row + i], slice(ends[i], ends[i + 1])
                if lang not in counts and len(counts) == _TASK_LANGUAGES:
                    yield from _emitted(counts, texts)
                    counts, texts = {}, {}
                counts.setdefault(lang, np.zeros(BINS, dtype=np.int64))
                counts[lang][found[own]] += n[own]
                texts[lang] = texts.get(lang, 0) + 1
    yield from _emitted(counts, texts)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log-probabilities by bin) from about ``fit_rows`` rows at most."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    sums = written(
        bounded_sample(known, "doc_id", fit_rows)
        .select("lang", "text")
        .mapInArrow(_counted, "lang string, bin long, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
    )
    most = sums.where("bin = -1").orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang")
    sums = sums.join(F.broadcast(most), "lang").toPandas()
    langs = sorted(sums["lang"].unique())
    if not langs:
        return [], np.zeros(0), np.zeros((BINS, 0))
    matrix = np.full((BINS, len(langs)), SMOOTHING)
    texts = np.zeros(len(langs))
    place = sums["lang"].map({lang: i for i, lang in enumerate(langs)}).to_numpy()
    bins, n = sums["bin"].to_numpy(), sums["n"].to_numpy()
    real = bins >= 0
    matrix[bins[real], place[real]] += n[real]
    texts[place[~real]] = n[~real]
    return langs, np.log(texts / texts.sum()), np.log(matrix / matrix.sum(axis=0))


def log_scores(rows: int, counts: Sparse, prior: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Texts by languages: the sparse counts times the log-probabilities, and the priors."""
    text, found, n = counts
    sums = [np.bincount(text, weights=n * lang[found], minlength=rows) for lang in logs.T]
    return prior + np.stack(sums, axis=1)


def _scored(model, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prior, logs = model.value
        logs = np.asfortranarray(logs)
        for batch in batches:
            best = [UNKNOWN] * batch.num_rows
            sure = np.zeros(batch.num_rows)
            judged = batch.column("__has_letter").to_pylist()
            for row, rows, counts in bin_counts(batch.column("__text")) if langs else ():
                total = log_scores(rows, counts, prior, logs)
                top = total.argmax(axis=1)
                above = total - total.max(axis=1, keepdims=True)
                share = 1.0 / np.exp(np.maximum(above, -700.0)).sum(axis=1)
                for i in range(rows):
                    if judged[row + i]:
                        best[row + i], sure[row + i] = langs[top[i]], share[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.array(best, pa.string()), pa.array(sure, pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    return run


def identified(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Columns of ``docs`` but ``text``, with ``lang_pred`` and its posterior ``score``.

    ``labelled`` has ``doc_id``, ``text`` and ``lang``; only it is learned from.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, fit_rows))
    replaced = ("text", "lang_pred", "score", "__text", "__has_letter")
    kept = [c for c in docs.columns if c not in replaced]
    rows = docs.select(
        *kept,
        F.col("text").alias("__text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__has_letter"),
    )
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    return rows.mapInArrow(_scored(model, kept), schema)
