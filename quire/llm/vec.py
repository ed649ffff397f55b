"""Whole columns of texts as numpy arrays, inside tasks: word places, word hashes, window hashes.

An Arrow string column is one buffer of UTF-8 bytes with offsets; words are found and hashed in that
buffer without making a Python object a word. Hashes have 64 bits; equal bytes give equal hashes in
every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text worked on at a time; a single longer text is worked on whole.
CHUNK = 500_000
#: Powers that a worker keeps: 8 bytes each.
KEPT_POWERS = 1_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """1, base, base ** 2, ...; a table longer than KEPT_POWERS goes with its user."""
    table = _powers.get(base, np.ones(1, U))
    if len(table) < n:
        step = np.full(n if n > KEPT_POWERS else min(KEPT_POWERS, max(n, 2 * len(table))), U(base), U)
        step[0] = U(1)
        table = np.multiply.accumulate(step)
        if n <= KEPT_POWERS:
            _powers[base] = table
    return table[:n]


def release() -> None:
    """Gives the memory that Arrow keeps for reuse back to the machine; called at the end of a task,
    since a worker stays alive for the next stage."""
    pa.default_memory_pool().release_unused()


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most limit bytes, or a single longer one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def runs(mark: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked places, cut at bounds."""
    n = len(mark)
    first, last = mark.copy(), mark.copy()
    first[1:] &= ~mark[:-1]
    last[:-1] &= ~mark[1:]
    inner = bounds[bounds < n]
    first[inner] = mark[inner]
    inner = bounds[(bounds > 0)] - 1
    last[inner] = mark[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs data[starts:ends], which don't overlap and come in order."""
    size = ends - starts
    full = np.flatnonzero(size)
    out = np.zeros(len(starts), U)
    if len(full):
        s, n = starts[full], size[full]
        at = np.concatenate([[0], np.cumsum(n)])
        inside = np.arange(at[-1]) - np.repeat(at[:-1], n)
        value = BYTE[data[inside + np.repeat(s, n)]] * powers(int(n.max()))[inside]
        out[full] = np.add.reduceat(value, at[:-1])
    return mix(out + size.astype(U) * U(0xD6E8FEB86659FD93))


class Words:
    """Words (runs of non-space bytes) of the texts data[bounds[i]:bounds[i + 1]].

    ``h``: a hash a word. ``first``: index of each text's first word, and the number of words last.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.data, self.bounds = LOWER[data] if lower else data, bounds
        self.mark = ~SPACE[data]
        self.starts, self.ends = runs(self.mark, bounds)
        self.h = hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, bounds)
        self.n = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k items from each place on, and the texts' ends repeated for each place: a place i
    begins a window of its text if i + k <= end[i]."""
    end = np.repeat(first[1:], np.diff(first))
    total = np.zeros(len(h), U)
    for j in range(min(k, len(h))):  # fewer than k items begin no window
        total[: len(h) - j] += mix(h[j:] + U(j * 2 + 1) * U(_BASE)) if k <= 3 else h[j:] * powers(k + 1)[j + 1]
    return mix(total), end


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags (one a byte or item) between bounds."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
