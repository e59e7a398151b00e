"""Flat text arrays: words, rolling hashes and window minima over whole columns of texts."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240131))
#: A random odd 64-bit value for each byte, and the multipliers of the rolling hashes.
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
HALF = 1 << 19
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i (mod 2 ** 64) for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 2 * HALF)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Hashes of values[start:end] (table[values], if given) for spans in the order of their starts.

    Works through stretches of the values, so memory is bounded by HALF values and the longest span.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + HALF, side="left"))
        part = values[base : max(int(ends[i:j].max()), base)]
        part = table[part] if table is not None else part
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def span_hash_any(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """`span_hash` for spans in any order."""
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), np.uint64)
    out[order] = span_hash(values, starts[order], ends[order], table)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte of each word of all rows, and where each row's words begin."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    after[:-1], after[-1] = inside[1:], False
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the least of each `width` consecutive values, the first if equal."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(values) < 1 << 24:
        return _window_min(values, width)
    step = (1 << 24) - width
    parts = [_window_min(values[i : i + step + width - 1], width) + i for i in range(0, n, step)]
    return np.concatenate(parts)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    # hash above, position below: equal hashes are told apart by place
    keyed = (values & ~U(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64)
    n, blocks = len(values) - width + 1, -(-len(values) // width)
    padded = np.full(blocks * width, U(2**64 - 1))
    padded[: len(values)] = keyed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & U(0xFFFFFF)).astype(np.int64)
