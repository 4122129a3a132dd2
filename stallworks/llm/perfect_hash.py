"""Minimal perfect hashes of string sets, with the keys stored for verification.

Keys fall into levels of bit arrays: on each level a key takes the place its hash names, keys that
meet on a place go on to the next level with another hash, and the slot of a key is the number of
bits before its own. ``n`` keys thus have the slots ``0 .. n - 1``. As any string falls on some
place, a lookup ends by comparing the string with the key that is stored for the slot; it is
exact whatever the hashes are. Keys whose hashes agree in all 64 bits never part, so what is
left after the last level takes the last slots and is searched by value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stallworks.llm.terms import utf8
from stallworks.llm.text import mix, span_hashes, stream

LEVELS = 24
_ROOM = 1.5
_U64 = np.uint64
_LEVEL_SEEDS = stream(41, LEVELS)


def string_hashes(values: pa.Array) -> np.ndarray:
    return span_hashes(*utf8(values))


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashes ^ _LEVEL_SEEDS[level]) % _U64(size)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    """Level sizes, bits of all levels as 64-bit words, bits before each word, keys by slot."""

    sizes: list[int]
    words: np.ndarray
    before: np.ndarray
    keys: pa.StringArray

    def slots(self, values: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The slot of every value, -1 for values that are no keys."""
        out = np.full(len(values), -1, dtype=np.int64)
        left, start = np.arange(len(values)), 0
        for level, size in enumerate(self.sizes):
            at = start + _places(hashes[left], level, size)
            word, bit = at >> 6, (at & 63).astype(_U64)
            here = (self.words[word] >> bit) & _U64(1) == 1
            below = self.words[word[here]] & ((_U64(1) << bit[here]) - _U64(1))
            out[left[here]] = self.before[word[here]] + np.bitwise_count(below)
            left, start = left[~here], start + -(-size // 64) * 64
        met = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[met])), values.take(pa.array(met)))
        out[met[~same.to_numpy(zero_copy_only=False)]] = -1
        placed = int(np.bitwise_count(self.words).sum())
        if placed < len(self.keys):
            rest = np.flatnonzero(out < 0)
            place = pc.index_in(values.take(pa.array(rest)), value_set=self.keys.slice(placed))
            place = place.fill_null(-1).to_numpy(zero_copy_only=False)
            out[rest[place >= 0]] = placed + place[place >= 0]
        return out


def perfect_hash(keys: pa.Array, hashes: np.ndarray | None = None) -> PerfectHash:
    """Of distinct strings without NULL; the same for the same set in any order."""
    keys = keys.take(pc.array_sort_indices(keys)) if hashes is None else keys
    hashes = string_hashes(keys) if hashes is None else hashes
    sizes, arrays, owners = [], [], []
    left = np.arange(len(keys))
    for level in range(LEVELS):
        if not len(left):
            break
        size = int(len(left) * _ROOM) + 1
        at = _places(hashes[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        owner = np.full(-(-size // 64) * 64, -1, dtype=np.int64)
        owner[at[alone[at]]] = left[alone[at]]
        sizes.append(size)
        arrays.append(owner >= 0)
        owners.append(owner[owner >= 0])
        left = left[~alone[at]]
    bits = np.concatenate(arrays) if arrays else np.zeros(0, dtype=bool)
    words = np.packbits(bits, bitorder="little").view(_U64)
    counts = np.bitwise_count(words).astype(np.int64)
    order = np.concatenate([*owners, left]) if owners else left
    return PerfectHash(sizes, words, np.cumsum(counts) - counts, keys.take(pa.array(order)))
