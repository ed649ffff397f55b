"""Burrows-Wheeler transforms of shards of strings, merged by iterative interleave refinement.

A string is a sequence of symbols; here a symbol stands for ``STEP`` bytes, and the byte strings that
begin at each of the ``STEP`` phases of a text are strings of their own, so that every byte has a suffix.
``transform`` sorts the suffixes of one shard and gives the symbol before each. ``merge`` interleaves any
number of shards without sorting suffixes again: the interleave starts as the shards one after another;
each round reads all transforms in its order and deals the places out by symbol, stably, which makes it
right for one symbol more. Where the groups of equal prefixes divide is carried along, so that after h
rounds the groups are the intervals of suffixes with a common prefix of h symbols.
"""

from __future__ import annotations

import numpy as np

from quire.llm.vec import BYTE, mix, powers

STEP = 50
END = 0  # ends every string; smaller than any symbol


def ranks(key: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys, in order."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def transform(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffix places and the symbol before each, for strings laid one after another, each closed
    by END at the places ``ends``. Equal suffixes are in order of place. Before a string's first symbol
    stands its own END, as in a circular string."""
    n = len(symbols)
    starts = np.concatenate([[0], ends[:-1] + 1])
    longest = int((ends - starts).max(initial=0)) + 1
    rank = symbols.astype(np.int64)
    scale = np.int64(max(n, int(rank.max(initial=0))) + 2)
    left = np.repeat(ends, ends - starts + 1) - np.arange(n)  # symbols from here to the string's end
    width = 1
    while width < longest:  # ranks of prefixes of twice the width
        after = np.zeros(n, np.int64)
        more = np.flatnonzero(left >= width)
        after[more] = rank[more + width] + 1
        rank = ranks(rank * scale + after)
        width *= 2
    order = np.argsort(rank, kind="stable")
    before = order - 1
    first = np.zeros(n, bool)
    first[starts] = True
    at_start = first[order]
    if at_start.any():
        before[at_start] = ends[np.searchsorted(starts, order[at_start])]
    return order, symbols[before]


def merge(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave (shard of each place) and the group of each place after ``rounds`` rounds."""
    sizes = [len(t) for t in transforms]
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    together = np.concatenate(transforms)
    group = np.zeros(len(shard), np.int32)
    for _ in range(rounds):
        read = np.empty_like(together)
        read[np.argsort(shard, kind="stable")] = together  # every shard is read in its own order
        order = np.argsort(read, kind="stable").astype(np.int32)
        read, group, shard = read[order], group[order], shard[order]
        new = np.ones(len(order), bool)
        new[1:] = (read[1:] != read[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return shard, group


def common(texts: list[np.ndarray], length: int, shard_bytes: int = 300_000) -> np.ndarray:
    """For every byte of the texts, laid one after another: the number of the group of places at which
    the same ``length`` bytes stand; -1 where fewer bytes are left. ``length`` is a multiple of STEP.
    Symbols are told apart by 64 bits of hash."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    n = len(data)
    out = np.full(n, -1, np.int64)
    if not n:
        return out
    # symbols: STEP bytes from each place on, numbered over all shards
    end = np.repeat(at[1:], size)
    whole = np.flatnonzero(np.arange(n) + STEP <= end)
    if not len(whole):
        return out
    value = np.zeros(len(whole), np.uint64)
    raw = BYTE[data]
    for j in range(STEP):
        value += raw[whole + j] * powers(STEP)[j]
    number = ranks(mix(value))
    symbol = np.zeros(n, np.int64)
    symbol[whole] = number + 1
    symbol = symbol.astype(np.uint16 if symbol.max() < 1 << 16 else np.int32)

    transforms, places = [], []
    cuts = np.unique(np.concatenate([[0], np.searchsorted(at, np.arange(shard_bytes, n, shard_bytes)), [len(texts)]]))
    cuts = cuts[cuts <= len(texts)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        # strings by (text, phase): whole symbols at phase, phase + STEP, ..., and an END
        phases = np.minimum(size[a:b], STEP)
        text = np.repeat(np.arange(a, b), phases)
        phase = np.arange(len(text)) - np.repeat(np.cumsum(phases) - phases, phases)
        n_symbols = (size[text] - phase) // STEP
        ends = np.cumsum(n_symbols + 1) - 1
        start = ends - n_symbols
        inside = np.arange(int(ends[-1]) + 1 if len(ends) else 0) - np.repeat(start, n_symbols + 1)
        place = np.repeat(at[text] + phase, n_symbols + 1) + inside * STEP
        is_end = np.zeros(len(place), bool)
        is_end[ends] = True
        place[is_end] = -1
        string = np.where(is_end, END, symbol[place]).astype(symbol.dtype)
        if len(string):
            order, before = transform(string, ends)
            transforms.append(before)
            places.append(place[order])
    shard, group = merge(transforms, length // STEP)
    into = np.argsort(shard, kind="stable")  # places of the merge in order of (shard, rank)
    place = np.concatenate(places)
    found = np.empty(len(place), np.int64)
    found[:] = group[into]
    real = place >= 0
    out[place[real]] = found[real]
    out[np.arange(n) + length > end] = -1
    return out
