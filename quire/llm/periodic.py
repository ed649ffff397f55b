"""Periodic runs of words, by longest previous factors.

A run is a stretch of words with smallest period q and a length of at least max(``LEAST``, ``TIMES`` * q) that no
neighbouring word extends. Every 5-word window in a run stands at least twice in its text (a period
further, or a period before), so only stretches of such windows can hold one; all else is left out first.

Stretches of a piece of texts are one string of integers with a sign of its own after each, so that no
repeat crosses their ends. On it (``Names``), equal substrings of 1, 2, 4, ... signs get equal names in
alphabetical order, which gives the suffix array and the common extension of any two places, forwards or
backwards, in a step a level. From suffix array and common prefixes one pass with a stack gives each
place's longest previous factor, and these the Lempel-Ziv blocks, each a copy of an earlier place.

* A run that crosses or touches a block's border is found there: the last border c before its end has a
  block that reaches the end, and the block before begins less than a period after the run's start. So
  one side of c holds two periods, and the period is bounded by the two blocks' lengths. For each period within
  these bounds the places c and c + p, or c - p and c, are extended both ways (Main). All (border, period)
  pairs together are no more than the string is long; nearly all are settled by comparing two names.
* A run inside a block is the copy of one inside the block's source, which begins earlier: going from left to right,
  it is taken from the runs there, ordered by start.

An interval found with several periods keeps the least. Texts are read where they lie; nothing is
shuffled. A task holds a piece of at most ``CHUNK`` bytes of texts, or one longer text: some hundred bytes for
each word of that text's stretches. Words are told apart by 64-bit hashes.

``collapse`` drops the words of each run after its first period.

Defined results: null and empty texts have no words, no runs and an empty collapsed text; null and repeated
ids are rows like others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.vec import Words, chunks, column, mix, release, runs, windows

# Least length of a run, least length in periods, words of a window that a run repeats.
LEAST, TIMES, SPAN = 6, 4, 5


class Names:
    """Names of all substrings of 2 ** k signs (shorter at the end); each row one k, padded by a name of its own."""

    def __init__(self, t: np.ndarray):
        n = len(t)
        rank, rows, width = np.unique(t, return_inverse=True)[1].astype(np.int32), [], 1
        while True:
            rows.append(np.append(rank, np.int32(-1)))
            if int(rank.max(initial=-1)) == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: max(n - width, 0)] = rank[width:].astype(np.int64) + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + after, return_inverse=True)[1].astype(np.int32)
            width *= 2
        self.n, self.rows = n, rows
        self.suffixes = np.argsort(rank, kind="stable")

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many signs are equal from places a and b (other than a) on."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            step = (self.rows[k][a] == self.rows[k][b]).astype(np.int64) << k
            a += step
            b += step
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many signs are equal before places a and b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            i, j = a - (1 << k), b - (1 << k)
            fits = (i >= 0) & (j >= 0)
            step = (fits & (self.rows[k][np.maximum(i, 0)] == self.rows[k][np.maximum(j, 0)])).astype(np.int64) << k
            a -= step
            b -= step
        return start - a


def previous_factors(suffixes: np.ndarray, common: np.ndarray) -> tuple[list[int], list[int]]:
    """Of each place the length of the longest factor that also begins earlier, and where it does.
    ``common[i]``: common prefix of suffixes i - 1 and i."""
    n = len(suffixes)
    size, source = [0] * n, [-1] * n
    places, shared = [], []  # rising places, each with its common prefix with the one below
    for place, now in zip([*suffixes.tolist(), -1], [*common.tolist(), 0], strict=True):
        while places and (place < places[-1] or now <= shared[-1]):
            top, below = places.pop(), shared.pop()
            if below >= now or place > top:
                size[top], source[top] = below, places[-1] if places else -1
            else:
                size[top], source[top] = now, place
            if place < top:
                now = min(below, now)
        places.append(place)
        shared.append(now)
    return size, source


def blocks(size: list[int], source: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Start, length and source of each Lempel-Ziv block; a new sign has length 1 and no source."""
    starts, lengths, sources, at = [], [], [], 0
    while at < len(size):
        starts.append(at)
        lengths.append(max(size[at], 1))
        sources.append(source[at] if size[at] else -1)
        at += lengths[-1]
    return starts, lengths, sources


def _pairs(starts: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each start with each period from 1 to its bound."""
    c = np.repeat(starts, most)
    return c, np.arange(len(c)) - np.repeat(np.cumsum(most) - most, most) + 1


def border_runs(names: Names, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Runs (start, end, period) that cross or touch a border, once an interval, with the least period."""
    before = np.append(0, lengths[:-1])
    third = (before + lengths - 1) // (TIMES - 1)
    found = []
    for right in (True, False):
        most = np.minimum(lengths // 2 if right else np.maximum(before - 1, 0), third)
        c, p = _pairs(starts, most)
        level = np.frexp(p.astype(np.float64))[1] - 1  # a common extension of p signs is one of 2 ** level
        same = np.zeros(len(c), bool)
        for k in np.unique(level[level < len(names.rows)]):
            some = np.flatnonzero(level == k)
            i, j = (c[some], c[some] + p[some]) if right else (c[some] - (1 << k), c[some] - p[some] - (1 << k))
            fits = (j >= 0) & (i >= 0) & (np.maximum(i, j) < names.n)
            some, i, j = some[fits], i[fits], j[fits]
            same[some] = names.rows[k][i] == names.rows[k][j]
        c, p = c[same], p[same]
        a, b = (c, c + p) if right else (c - p, c)
        ahead, back = names.forward(a, b), names.backward(a, b)
        enough = (ahead + back >= (TIMES - 1) * p) & (ahead + back + p >= LEAST)
        found.append(np.stack([a - back, b + ahead, p], 1)[enough])
    every = np.concatenate(found)
    every = every[np.lexsort(every.T[::-1])]
    first = np.ones(len(every), bool)
    first[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    return every[first]


def with_copies(found: np.ndarray, starts: list[int], lengths: list[int], sources: list[int]) -> list[tuple[int, int, int]]:
    """All runs by start: those of the borders, and those inside a block from the runs in its source."""
    waiting, done, at = deque(map(tuple, found.tolist())), [], []

    def settle(run: tuple[int, int, int]) -> None:
        done.append(run)
        at.append(run[0])

    for c, size, source in zip(starts, lengths, sources, strict=True):
        while waiting and waiting[0][0] < c:
            settle(waiting.popleft())
        if size < LEAST + 2:
            continue
        i, copies, shift = bisect_right(at, source), deque(), c - source
        while True:
            while i < len(done) and at[i] < source + size:
                s, e, p = done[i]
                if e < source + size:
                    copies.append((s + shift, e + shift, p))
                i += 1
            if copies and not (waiting and waiting[0][0] < copies[0][0]):
                settle(copies.popleft())
            elif waiting and waiting[0][0] < c + size:
                settle(waiting.popleft())
            else:
                break
    return [*done, *waiting]


def runs_of(t: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a string of integers whose last sign stands nowhere else."""
    if not len(t):
        return []
    names = Names(t)
    common = np.zeros(len(t), np.int64)
    common[1:] = names.forward(names.suffixes[:-1], names.suffixes[1:])
    starts, lengths, sources = blocks(*previous_factors(names.suffixes, common))
    return with_copies(border_runs(names, np.array(starts), np.array(lengths)), starts, lengths, sources)


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (words) of what windows cover that their text repeats."""
    h, end = windows(w.h, w.first, SPAN)
    place = np.flatnonzero(np.arange(len(h)) + SPAN <= end)
    key = h[place] ^ mix(w.text_of()[place].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = place[order[same[:-1] | same[1:]]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + SPAN, -1)
    s, e = runs(np.cumsum(edge[:-1]) > 0, w.first)
    long = e - s >= LEAST
    return s[long], e[long]


def find(w: Words) -> np.ndarray:
    """All runs of the texts: first word, word after the last, period; by start, then period. Words count over all texts."""
    s, e = stretches(w)
    if not len(s):
        return np.zeros((0, 3), np.int64)
    size = e - s + 1  # with a sign of its own at the end
    at = np.cumsum(size) - size
    shift = np.repeat(s - at, size)
    closing = at + size - 1
    word = np.arange(len(shift)) + shift
    word[closing] = 0
    t = np.unique(w.h[word], return_inverse=True)[1].astype(np.int64)
    t[closing] = t.max() + 1 + np.arange(len(closing))
    out = np.array(runs_of(t), np.int64).reshape(-1, 3)
    out[:, :2] += shift[out[:, 0]][:, None]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(w: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts without the words of a run after its first period, one space between words."""
    edge = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    kept = np.cumsum(edge[:-1]) == 0
    word = np.flatnonzero(kept)
    left = np.append(0, np.cumsum(kept))[w.first]  # kept words before each text
    size = w.ends[word] - w.starts[word] + 1
    last = left[1:][np.diff(left) > 0] - 1
    size[last] -= 1  # no space after a text's last word
    upto = np.append(0, np.cumsum(size))
    out = np.full(upto[-1], 0x20, np.uint8)
    length = w.ends[word] - w.starts[word]
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(upto[:-1], length) + inside] = w.data[np.repeat(w.starts[word], length) + inside]
    return out, upto[left]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = column(batch.column(1))
        for a, b in chunks(offsets):
            bounds = offsets[a : b + 1]
            w = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0], lower=False)
            found = find(w)
            text = np.searchsorted(w.first, found[:, 0], "right") - 1
            fields = [found[:, 0] - w.first[text], found[:, 1] - found[:, 0], found[:, 2]]
            each = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "length", "period"])
            counts = np.searchsorted(text, np.arange(b - a + 1))
            out, upto = collapse(w, found)
            texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(out))
            columns = [batch.column(0).slice(a, b - a), pa.array(w.n), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), each), texts.cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
    release()


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``, a row each of ``docs``: runs as (start, length, period), by start
    and then period, and the text without repeated periods."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_found, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest length in periods, compared exactly; the first on a tie."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))
