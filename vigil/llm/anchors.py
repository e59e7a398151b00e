"""Anchored windows: which windows of W elements share their least k-gram, and what surrounds it.

Each window of a text chooses the k-gram in it with the least hash (the first, if equal). Equal windows
choose the same k-gram at the same offset, so windows only have to be compared under one anchor.
The windows that one occurrence of an anchor is chosen by stand together, from `a` to `b`; the
elements they cover, `a` to `b + W`, are the anchor's context.
"""

from __future__ import annotations

import numpy as np

from vigil.llm import flat


def gram_hash(values: np.ndarray, k: int, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of k values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for i in range(0, n, flat.HALF):
        part = values[i : min(i + flat.HALF, n) + k - 1]
        part = table[part] if table is not None else part
        up, down = flat.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        size = len(part) - k + 1
        out[i : i + size] = flat.mix((sums[k:] - sums[:-k]) * down[:size])
    return out


def anchors(values: np.ndarray, first: np.ndarray, k: int, window: int, table: np.ndarray | None = None):
    """(row, node, context, anchor - a, a, b) of all anchors; positions count from the row's beginning.

    first: where each row's values begin.
    """
    none = np.empty(0, np.int64)
    if len(values) < window:
        return none, none, none, none, none, none
    gram = gram_hash(values, k, table)
    chosen = flat.window_min(gram, window - k + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(row[: len(chosen)] == row[window - 1 :])
    if not len(inside):
        return none, none, none, none, none, none
    at = chosen[inside]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    begins = np.flatnonzero(new)
    a, b, p = inside[begins], inside[np.append(begins[1:], len(at)) - 1], at[begins]
    own = row[a]
    context = flat.mix(flat.span_hash(values, a, b + window, table) + (p - a).astype(np.uint64))
    base = first[own]
    return own, gram[p].view(np.int64), context.view(np.int64), p - a, a - base, b - base


def window_hashes(values: np.ndarray, spans: list[tuple[int, int]], window: int, table: np.ndarray | None = None) -> list[np.ndarray]:
    """For each (a, b) the hashes of the windows that begin at a to b."""
    return [gram_hash(values[a : b + window], window, table).view(np.int64) for a, b in spans]


def covered(spans: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` elements lie in one of the [start, end) rows of `spans`."""
    marks = np.zeros(size + 1, np.int64)
    if len(spans):
        np.add.at(marks, spans[:, 0], 1)
        np.add.at(marks, spans[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0
