"""Runs of bytes as Arrow strings, without a Python object for each of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from stallworks.llm.text import NOT_LETTER, spans

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# More bytes at a time than elsewhere: the rows that leave a block are counted, and a larger
# block leaves fewer of them.
COUNT_BLOCK_BYTES = 8 << 20


def runs(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = NOT_LETTER
) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Every run of bytes that are no breaks, A-Z lower-cased; where it starts; its row."""
    starts, lengths, before = spans(data, offsets, breaks)
    ends = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=ends[1:])
    letters = _LOWER[data[~breaks[data]]]
    found = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(letters))
    return found, starts, np.repeat(np.arange(len(offsets) - 1), np.diff(before))


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact codes of values, and the distinct values in the order of their codes."""
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of an array of strings without NULL."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, raw, data = values.buffers()
    kind = np.int64 if pa.types.is_large_string(values.type) else np.int32
    offsets = np.frombuffer(raw, dtype=kind)[values.offset : values.offset + len(values) + 1]
    offsets = offsets.astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, offsets[:-1], np.diff(offsets)
