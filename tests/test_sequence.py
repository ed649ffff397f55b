"""Positions, running values, packing and chunk plans against plain loops, with sequences over many blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import planning, sequence

RUNS = ("LIST_ITEM", "QUOTE", "POETRY")


def greedy(items, most, target):
    """Piece numbers of [(n, size, forced)]."""
    out, piece, n, z = [], -1, 0, 0
    for i, (a, b, forced) in enumerate(items):
        if i == 0 or forced or n + a > most or z + b > target:
            piece, n, z = piece + 1, 0, 0
        n, z = n + a, z + b
        out.append(piece)
    return out


@pytest.mark.parametrize("block", [8, 64])
def test_pack(spark, monkeypatch, block):
    monkeypatch.setattr(sequence, "ITEMS", 2 * block)
    rng = random.Random(block)
    groups = {key: [(rng.randint(1, 3), rng.choice([0, 1, 5, 9, 30, 200]), rng.random() < 0.05) for _ in range(size)] for key, size in ((1, 1), (2, 7), (None, 90), (3, 700), (4, block), (5, 2 * block + 1))}
    rows = [(k, i, *x) for k, items in groups.items() for i, x in enumerate(items)]
    df = spark.createDataFrame(rows, "k long, i long, n int, z int, f boolean").repartition(3)
    found = sequence.pack(df, ["k"], "i", "n", "z", most=6, target=60, forced=F.col("f"))
    got = {}
    for r in found.orderBy("i").collect():
        got.setdefault(r.k, []).append(r.piece)
    assert got == {k: greedy(items, 6, 60) for k, items in groups.items()}
    assert sequence.pack(df.limit(0), ["k"], "i", "n", "z", most=6, target=60).isEmpty()


def test_number_and_running(spark, monkeypatch):
    """A key with most of the rows lies in several buckets and blocks."""
    monkeypatch.setattr(sequence, "ROWS", 16)
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i * 3 + 1, rng.randint(0, 9), rng.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, at long, v int, s string").repartition(4)
    found = sequence.number(df, ["k"], F.col("at"), before={"was": F.col("s")})
    spread = sequence.running(df, ["k"], "at", sums={"total": F.col("v")}, before={"last_v": F.col("v"), "last_s": F.col("s")})
    for key in (1, 2, None):
        mine = [r for r in rows if r[0] == key]
        of = lambda x: x.where(F.col("k").eqNullSafe(F.lit(key).cast("long"))).orderBy("at").collect()  # noqa: B023, E731
        assert [(r.at, r.position, r.was) for r in of(found)] == [(r[1], i + 1, mine[i - 1][3] if i else None) for i, r in enumerate(mine)]
        assert [(r.total, r.last_v, r.last_s) for r in of(spread)] == [(sum(x[2] for x in mine[: i + 1]), *((mine[i - 1][2], mine[i - 1][3]) if i else (None, None))) for i, _ in enumerate(mine)]


def test_chunk_context_plans_once(spark, tmp_path):
    """The context of chunks is asked of a table of their first segments: the plan is read once. Units come without a sort of all segments."""
    rows = [(c, i, c * 1000 + i, "x" * 40, "PARAGRAPH", "TRANSLATED", "y") for c in range(3) for i in range(1, 90)]
    s = spark.createDataFrame(rows, "chapter_id long, segment_order long, segment_id long, source_text string, segment_type string, status string, translated_text string")
    s.write.parquet(f"{tmp_path}/s")
    found = planning.chunk_context(planning.chunk_plan(spark.read.parquet(f"{tmp_path}/s")), s)
    assert {p.split("/")[-2] for p in found.inputFiles()} == {"first"}
    assert {(r.chapter_id, r.chunk): r.context for r in found.collect()} == {(c, k): [c * 1000 + 40 * k + j for j in range(-3, 1)] if k else [] for c in range(3) for k in range(3)}
    assert not any("/ranged/" in p for p in planning.units(s).inputFiles())


def test_ties_have_places_of_their_own(spark):
    df = spark.createDataFrame([(1, 5)] * 9 + [(1, 4), (2, 5)], "k long, at long").repartition(3)
    found = sorted((r.k, r.position) for r in sequence.number(df, ["k"], F.col("at")).collect())
    assert found == [(1, i) for i in range(1, 11)] + [(2, 1)]


def plain_plan(rows, target, most):
    """Chunks of [(text, type)] of one chapter as lists of indices, by the rules one after another."""
    said = lambda t: (t := t.strip())[:1] in tuple("\"'“‘—") and t != "" or t.startswith("- ") or t.endswith(("\"", "”")) or t.lower().startswith(("he said", "she said", "said "))
    run = [k if k in RUNS else "talk" if k == "PARAGRAPH" and said(t) else None for t, k in rows]
    size = [len(t) for t, _ in rows]
    units, i = [], 0
    while i < len(rows):
        unit = [i]
        while run[i] and unit[-1] + 1 < len(rows) and run[unit[-1] + 1] == run[i] and len(unit) < most and sum(size[j] for j in unit) + size[unit[-1] + 1] <= target:
            unit.append(unit[-1] + 1)
        units.append(unit)
        i = unit[-1] + 1
    merged = []
    for unit in units:
        before = merged[-1] if merged else None
        if before and len(before) == 1 and rows[before[0]][1] == "TITLE" and rows[unit[0]][1] != "TITLE" and 1 + len(unit) <= most and size[before[0]] + sum(size[j] for j in unit) <= target:
            merged[-1] = before + unit
        else:
            merged.append(unit)
    pieces = greedy([(len(u), sum(size[j] for j in u), rows[u[0]][1] == "TITLE") for u in merged], most, target)
    return [[j for u, q in zip(merged, pieces, strict=True) if q == p for j in u] for p in range(max(pieces, default=-1) + 1)]


def plans(spark, chapters, target, most):
    rows = [(c, 10 * i + 1, 1000 * c + i, t, k) for c, rows in chapters.items() for i, (t, k) in enumerate(rows)]
    s = spark.createDataFrame(rows, "chapter_id long, segment_order long, segment_id long, source_text string, segment_type string").repartition(3)
    out = {}
    for r in planning.chunk_plan(s, target=target, most=most).orderBy("chapter_id", "chunk").collect():
        assert r.chunk == len(out.setdefault(r.chapter_id, [])) and r.n_segments == len(r.segment_ids)
        assert r.chars == sum(len(chapters[r.chapter_id][i - 1000 * r.chapter_id][0]) for i in r.segment_ids)
        out[r.chapter_id].append([i - 1000 * r.chapter_id for i in r.segment_ids])
    return out


def test_chunk_plan_cases(spark):
    P, T, L = "PARAGRAPH", "TITLE", "LIST_ITEM"
    long = "The lamps went out one by one along the quiet quay."
    cases = [
        ((20, 2), [("brief", P), ("a second one", P), ("three", P)], [[0, 1], [2]]),
        ((1000, 5), [("The Quay", T), ("x", P), ("The Bridge", T)], [[0, 1], [2]]),
        ((1000, 5), [("a", P), ("b", L), ("c", L), ("d", P)], [[0, 1, 2, 3]]),
        ((60, 10), [(long, P), ("“Who is there?”", P), ("“Only the tide.”", P), ("No one else spoke.", P)], [[0], [1, 2, 3]]),
        ((1000, 10), [("a", "QUOTE"), ("b", "QUOTE"), ("c", "POETRY"), ("d", "POETRY")], [[0, 1, 2, 3]]),
        ((10, 3), [("One", T), ("Two", T), ("a long paragraph here", P), ("x", P)], [[0], [1], [2], [3]]),
        ((30, 3), [("T", T), ("a", L), ("b", L), ("c", L), ("d", L)], [[0], [1, 2, 3], [4]]),
    ]
    for (target, most), rows, want in cases:
        assert plain_plan(rows, target, most) == want
        assert plans(spark, {1: rows}, target, most) == {1: want}


@pytest.mark.parametrize("target,most", [(60, 4), (25, 3)])
def test_chunk_plan_against_a_loop(spark, monkeypatch, target, most):
    monkeypatch.setattr(sequence, "ITEMS", 16)
    monkeypatch.setattr(sequence, "ROWS", 32)
    rng = random.Random(target)
    kinds = ["TITLE", "PARAGRAPH", "PARAGRAPH", *RUNS, "OTHER"]

    def some(n):
        rows, kind = [], "TITLE"
        for _ in range(n):
            kind = kind if rng.random() < 0.6 else rng.choice(kinds)
            rows.append((rng.choice(["“", "— ", "", "", "Said "]) + "x" * rng.choice([1, 3, 8, 20, 40]), kind))
        return rows

    chapters = {1: some(1), 2: some(9), 3: some(400), 4: [("q", "QUOTE")] * 100}
    assert plans(spark, chapters, target, most) == {c: plain_plan(rows, target, most) for c, rows in chapters.items()}
