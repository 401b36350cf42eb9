"""Word shingles of whole texts, hashed with numpy over Arrow buffers.

A word is a run of bytes outside U+0020 and U+0009..U+000D; A-Z are lower-cased, nothing else is
changed.  Every word gets a 64-bit hash (a keyed prefix sum over its bytes), every run of ``width``
words gets a 64-bit hash of its word hashes.  A text with fewer words than ``width`` has its whole
word sequence as the one shingle; a text without words (or null) has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone.
BLOCK = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _odd(11, 256)
_STEP = int(_odd(12, 1)[0])
_UNSTEP = pow(_STEP, -1, 2**64)
_SLOT = _odd(13, 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept as far as any call needed them."""
    have = _POWERS.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have[: n - len(have)] * np.uint64(pow(base, len(have), 2**64))])
    _POWERS[base] = have
    return have[:n]


def run_hashes(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Hashes of data[edge[0]:edge[1]], data[edge[2]:edge[3]] and so on, without regard to the case of A-Z."""
    start, end = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _powers(_STEP, len(data)), out=sums[1:])
    hashes = (sums[end] - sums[start]) * _powers(_UNSTEP, len(data) + 1)[start]
    return mix(hashes + (end - start).astype(np.uint64) * _SLOT[63])


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of all words in a byte array."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    return edge[0::2], run_hashes(data, edge)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (length rows + 1) of a string column; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows with about block bytes: their number, their bytes with a space after each row, and its rows' ends there."""
    data, offsets = text_buffers(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + block, "right")) - 1)
        lengths = np.diff(offsets[row : last + 1])
        spaced = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
        keep = np.ones(len(spaced), dtype=bool)
        keep[np.cumsum(lengths + 1) - 1] = False
        spaced[keep] = data[offsets[row] : offsets[last]]
        yield last - row, spaced, np.cumsum(lengths + 1)
        row = last


def shingle_sets(column: pa.Array, width: int = 5, block: int = BLOCK) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row, one array a row, whole texts."""
    for _, spaced, ends in blocks(column, block):
        start, words = word_hashes(spaced)
        first = np.searchsorted(start, np.concatenate([[0], ends]))
        rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for k in range(width):
            rolled += words[k : k + len(rolled)] * _SLOT[k]
        rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                short = words[a:b] * _SLOT[: b - a]
                yield mix(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
