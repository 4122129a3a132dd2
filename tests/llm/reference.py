"""Brute-force versions of the operators, over plain Python rows."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[str]:
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [w.translate(_LOWER) for w in found] if lower else found


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words(text, lower=True)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups(ids, links) -> dict:
    """Smallest reachable id of every id."""
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in parent}


def near_links(rows: list[tuple[int, str | None]], k: int, percent: int) -> list[tuple[int, int]]:
    sets = {d: shingle_set(t, k) for d, t in rows}
    by_shingle = defaultdict(list)
    found = []
    for d in sets:
        shared = Counter()
        for s in sets[d]:
            shared.update(by_shingle[s])
            by_shingle[s].append(d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                found.append((o, d))
    return found


def cut_words(rows: list[tuple[int, str | None]], window: int) -> dict[int, tuple[list, list]]:
    """(kept words, flags of all words) of each document."""
    first: dict[tuple, int] = {}
    for d, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = ([x for x, g in zip(w, gone) if not g], gone)
    return out


def sha256(kept: list[str]) -> str:
    return hashlib.sha256(" ".join(kept).encode()).hexdigest()


def leaks(docs, items, window: int = 13, mismatches: int = 2) -> dict[tuple[int, int], int]:
    """Every alignment of every document with every item."""
    out = {}
    for (d, text), (i, passage) in itertools.product(docs, items):
        w, b = words(text, lower=True), words(passage, lower=True)
        if len(b) < 9:
            continue
        width = min(window, len(b))
        needed = width - width * mismatches // window
        for shift in range(-len(b) + 1, len(w)):
            equal = [
                0 <= p + shift < len(w) and w[p + shift] == b[p] for p in range(len(b))
            ]
            if any(sum(equal[p : p + width]) >= needed for p in range(len(b) - width + 1)):
                out[d, i] = max(out.get((d, i), 0), sum(equal))
    return out
