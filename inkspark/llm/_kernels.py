"""Array kernels over batches of texts: words, word hashes and five-word shingles without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
SHINGLE = 5
_WEIGHTS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, byte offsets of the rows) of slices of about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of a slice, and per row the number of words before it (length rows + 1)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))[: len(data)] | solid & edge[:-1])
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True]))[: len(data)] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the words; with ``fold``, A-Z count as a-z."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of five-word windows in order and, per row, the number of windows before it.

    A row of one to four words has one window, its whole sequence; a row without words has none.
    """
    counts = np.diff(first)
    total = np.zeros(len(words), np.uint64)
    for k, weight in enumerate(_WEIGHTS[: len(words)]):
        total[: len(words) - k] += words[k:] * np.uint64(weight)
    windows = np.where(counts >= SHINGLE, counts - SHINGLE + 1, 0)
    ok = np.ones(len(words), bool)
    for k in range(1, SHINGLE):
        at = first[1:] - k
        ok[at[at >= first[:-1]]] = False
    for row in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        part = words[first[row] : first[row + 1]]
        value = sum(int(w) * f for w, f in zip(part, _WEIGHTS, strict=False)) + len(part)
        total[first[row]] = value & _MASK
        ok[first[row]] = True
        windows[row] = 1
    return mix(total[ok]), np.concatenate(([0], np.cumsum(windows)))


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) for every row of a batch, in order."""
    for start, stop, data, offsets in text_slices(column):
        s, e, first = word_spans(data, offsets)
        hashes, at = shingle_hashes(word_hashes(data, s, e), first)
        for row in range(stop - start):
            yield start + row, np.unique(hashes[at[row] : at[row + 1]])
