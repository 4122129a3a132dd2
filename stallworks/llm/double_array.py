"""Double-array tries over byte strings, built and walked with numpy.

A state ``s`` has a child for byte ``c`` if ``check[base[s] + c] == s``, and the child is that place.
``accept`` holds the number of the string that ends in a state, -1 elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROOT = 0
_ALPHABET = 256
_ROOM = 2
_TRIES = 64


@dataclass(frozen=True)
class DoubleArray:
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray

    def step(self, states: np.ndarray, symbols: np.ndarray | int) -> np.ndarray:
        """The next state of each, -1 where there is none; no state may be -1."""
        to = self.base[states] + symbols
        return np.where(self.check[to] == states, to, -1)

    def walk(
        self, states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> np.ndarray:
        """States after all bytes of one span per state, all spans advancing together."""
        out = states.copy()
        alive = np.flatnonzero((out >= 0) & (lengths > 0))
        now, at = out[alive], starts[alive]
        ends = at + lengths[alive]
        while len(alive):
            now = self.step(now, data[at])
            at = at + 1
            more = (now >= 0) & (at < ends)
            out[alive[~more]] = now[~more]
            left = np.flatnonzero(more)
            alive, now, at, ends = alive[left], now[left], at[left], ends[left]
        return out


def _nodes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted distinct keys: parent and symbol of every node, and the node each key ends in.

    Keys with a common prefix are neighbours, so a node begins where the parent or the byte
    differs from that of the key before.
    """
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    starts = np.cumsum(lengths) - lengths
    node = np.zeros(len(keys), dtype=np.int64)
    parents, symbols = [np.array([-1])], [np.array([0])]
    total, alive, depth = 1, np.flatnonzero(lengths > 0), 0
    while len(alive):
        symbol = data[starts[alive] + depth].astype(np.int64)
        parent = node[alive]
        first = np.ones(len(alive), dtype=bool)
        first[1:] = (parent[1:] != parent[:-1]) | (symbol[1:] != symbol[:-1])
        node[alive] = total + np.cumsum(first) - 1
        parents.append(parent[first])
        symbols.append(symbol[first])
        total += int(first.sum())
        depth += 1
        alive = alive[lengths[alive] > depth]
    return np.concatenate(parents), np.concatenate(symbols), node


def double_array(keys: list[bytes]) -> DoubleArray:
    """The trie of distinct byte strings; the number of a string is its place in sorted order.

    Nodes are placed many at a time, those with most children first: each draws a base, and
    all whose children fall on free places, which no other node of the turn asks for, take
    them. A node that finds no place in many turns gets fresh places behind the others.
    """
    keys = sorted(keys)
    parent, symbol, ends = _nodes(keys)
    n = len(parent)
    order = np.argsort(parent[1:], kind="stable") + 1
    owners, first, count = np.unique(parent[order], return_index=True, return_counts=True)
    size = max(n * _ROOM, 4 * _ALPHABET)
    taken = np.zeros(size + _ALPHABET, dtype=bool)
    taken[ROOT] = True
    base_of = np.zeros(n, dtype=np.int64)
    state = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(17)
    fresh, extra = size + _ALPHABET, 0
    # Classes of nodes with about equally many children are placed together.
    rank = np.ceil(np.log2(count)).astype(int)
    for level in range(int(rank.max(initial=0)), -1, -1):
        left = np.flatnonzero(rank == level)
        for _ in range(_TRIES):
            if not len(left):
                break
            draw = rng.integers(1, size, len(left))
            which = np.repeat(np.arange(len(left)), count[left])
            within = np.arange(len(which)) - np.repeat(np.cumsum(count[left]) - count[left], count[left])
            children = order[first[left][which] + within]
            to = draw[which] + symbol[children]
            _, inverse, asked = np.unique(to, return_inverse=True, return_counts=True)
            clash = taken[to] | (asked[inverse] > 1)
            # Of nodes that meet, the first one may stay if nothing else is in its way.
            met = np.bincount(which, weights=clash, minlength=len(left)) > 0
            free = ~met[which]
            taken[to[free]] = True
            state[children[free]] = to[free]
            base_of[owners[left[~met]]] = draw[~met]
            left = left[met]
        for node in left.tolist():
            children = order[first[node] : first[node] + count[node]]
            base_of[owners[node]] = fresh + extra
            state[children] = fresh + extra + symbol[children]
            extra += _ALPHABET
    length = fresh + extra + _ALPHABET
    base = np.zeros(length, dtype=np.int32)
    check = np.full(length, -1, dtype=np.int32)
    accept = np.full(length, -1, dtype=np.int32)
    base[state] = base_of
    check[state[1:]] = state[parent[1:]]
    accept[state[ends]] = np.arange(len(keys))
    return DoubleArray(base, check, accept)
