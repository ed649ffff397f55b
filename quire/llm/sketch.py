"""SetSketch registers of word-shingle sets.

A register holds the truncated minimum of exponential variables, one for each element of the set, on an
exponentially spaced scale of base ``BASE``: K = floor(1 - log_BASE(min)), cut to 0..LIMIT. Registers of
a union are the maxima of the registers (``merge``), registers of two sets are equal about as often as
their Jaccard similarity says, and two sketches give the similarity by maximum likelihood
(``log_likelihood``) from how many registers of one are larger, smaller or equal.
"""

from __future__ import annotations

import numpy as np

from quire.llm.vec import Words, mix

M, ROWS = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
FACTORS = mix(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
#: Elements hashed at a time, so that they stay in the processor's cache.
STEP = 32_768


def shingles(data: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of lower-cased texts, text by text and sorted within each, and
    the bounds of the texts' runs. Fewer words than k are one shingle; without words there is none."""
    w = Words(data, bounds, lower=True)
    n = len(w.n)
    size = np.where(w.n >= k, w.n - k + 1, np.minimum(w.n, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1] - w.first[:-1], size)
    length = np.repeat(np.minimum(w.n, k), size)
    total = np.zeros(len(place), np.uint64)
    for j in range(k):
        inside = length > j
        total[inside] = mix(total[inside] * np.uint64(0xD6E8FEB86659FD93) + w.h[place[inside] + j])
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((total, owner))
    total = total[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def registers(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, M) registers; an empty set has zeros."""
    n = len(bounds) - 1
    least = np.full((n, M), np.iinfo(np.uint64).max, np.uint64)
    size = np.diff(bounds)
    full = np.flatnonzero(size)
    a = 0
    while a < len(full):
        b = max(a + 1, int(np.searchsorted(bounds[full], bounds[full[a]] + STEP, "right")) - 1)
        some = full[a:b]
        start, end = bounds[some[0]], bounds[some[-1] + 1]
        for lo in range(start, end, STEP) if b == a + 1 else [start]:
            h = elements[lo : min(end, lo + STEP) if b == a + 1 else end]
            at = bounds[some] - start if b > a + 1 else np.array([0])
            for i in range(M):
                found = np.minimum.reduceat(h * FACTORS[i], at)
                least[some, i] = np.minimum(least[some, i], found)
        a = b
    with np.errstate(divide="ignore"):
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        k = np.floor(1 - np.log(x) / np.log(BASE))
    k = np.clip(k, 0, LIMIT + 1)
    k[size == 0] = 0
    return k.astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray) -> np.ndarray:
    """(sets, M / ROWS) band values: ROWS registers of 16 bits each make 64 bits."""
    return np.ascontiguousarray(regs).view(np.uint64)


def identity(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, 2) values that equal sets share and others don't: two sums of mixed elements."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for j, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(elements ^ np.uint64(salt)), dtype=np.uint64)])
        out[:, j] = total[bounds[1:]] - total[bounds[:-1]]
    return out


def _larger(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Log-likelihood of similarity j for sets of known sizes, of which ``more`` registers are larger in
    a and ``less`` in b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _larger(u - v * j), _larger(v - u * j)
    return more * np.log(p) + less * np.log(q) + (M - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))


def may_reach(j: float, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, doubt: float = 18.0) -> np.ndarray:
    """False where similarity j or more is refuted: the likelihood ratio of the best lower similarity to
    j exceeds exp(doubt), six standard deviations."""
    best = np.full(len(n_a), -np.inf)
    for other in np.linspace(0.02, j, 30):
        best = np.maximum(best, log_likelihood(np.full(len(n_a), other), n_a, n_b, more, less))
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    at = np.maximum(*(log_likelihood(np.minimum(x, top), n_a, n_b, more, less) for x in (np.full(len(n_a), j), np.full(len(n_a), (1 + j) / 2))))
    return best - at <= doubt
