"""Words and hashes of whole texts: column expressions, and numpy over Arrow buffers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. The numpy side works on the UTF-8 buffer that Arrow hands over, so no
Python object is made for a text or a word. Long inputs are hashed in pieces that end
at a separator; temporary arrays are bounded by the piece (or by one longer word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"

# Rows of one Arrow batch are worked on in blocks of about this many bytes.
BLOCK_BYTES = 2 << 20
_PIECE = 1 << 19

_U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finalizer, element by element."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values that depend on the seed alone."""
    start = _U64((seed * 0xD1342543DE82EF95 + 1) & _MASK)
    return mix(start + np.arange(1, n + 1, dtype=_U64) * _U64(_STEP))


_BYTE_VALUES = stream(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x5851F42D4C957F2D  # odd, so powers never vanish

IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[0x20, *range(0x09, 0x0E)]] = True

# Bytes outside a run of letters; every byte of a character beyond ASCII counts as a letter.
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[0x80:] = False
NOT_LETTER[ord("a") : ord("z") + 1] = False
NOT_LETTER[ord("A") : ord("Z") + 1] = False


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), _U64(base & _MASK), dtype=_U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(_BASE, 256)


def _first_powers(n: int) -> np.ndarray:
    return _POWERS[:n] if n <= len(_POWERS) else powers(_BASE, n)


def text_blocks(
    column: pa.Array, block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    raw_offsets, data = column.buffers()[1:3]
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, whole[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def spans(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_BREAK
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every word, and for each row the number of words before it."""
    if len(data) == 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    inside = ~breaks[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(opens)
    lengths = np.flatnonzero(closes) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


def span_hashes(
    data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = False
) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes everywhere."""
    out = np.empty(len(starts), dtype=_U64)
    at = 0
    totals = np.cumsum(lengths)
    while at < len(starts):
        before = totals[at - 1] if at else 0
        stop = int(np.searchsorted(totals, before + _PIECE, side="right"))
        stop = min(max(stop, at + 1), len(starts))
        n = lengths[at:stop]
        firsts = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(firsts, n)
        symbols = data[within + np.repeat(starts[at:stop], n)]
        if lower:
            symbols = _LOWER[symbols]
        terms = _BYTE_VALUES[symbols] * _first_powers(int(n.max()))[within]
        out[at:stop] = mix(np.add.reduceat(terms, firsts) + n.astype(_U64) * _U64(_STEP))
        at = stop
    return out


def grams(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of k consecutive words at every place where k words are left."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U64)
    factors = stream(seed, k) | _U64(1)
    total = np.zeros(n, dtype=_U64)
    for j in range(k):
        total += hashes[j : j + n] * factors[j]
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` consecutive values, by doubling."""
    reach, best = 1, values
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:]) if len(best) > reach else best[:0]
        reach *= 2
    rest = width - reach
    if rest:
        best = np.minimum(best[:-rest], best[rest:]) if len(best) > rest else best[:0]
    return best


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Consecutive values cut into lists of the given lengths."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
