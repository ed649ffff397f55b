"""Periodic runs against a plain version that tries every period."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from brute import WORD, sha
from quire.llm import periodic, queries

SF = "/root/testdata/sf0.001"
EXTRA = "runs string, n_words int, collapsed long"


def every_run(ws):
    """[(start, end, period)] by start, then period."""
    ids = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    t, out = np.array([ids[w] for w in ws]), []
    for p in range(1, len(t) // 4 + 1):
        eq = np.append(np.append(False, t[p:] == t[:-p]), False).astype(np.int8)
        step = np.diff(eq)
        for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
            s, e = int(s), int(e) + p
            if e - s >= max(6, 4 * p) and not any(p % q == 0 and (t[s : e - q] == t[s + q : e]).all() for q in range(1, p)):
                out.append((s, e, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, runs):
    gone = {i for s, e, p in runs for i in range(s + p, e)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def plant(doc_id, ws):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(ws)
    if h % 10 or not n:
        return ws
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]


def contract(rows):
    out = []
    for d, text in rows:
        ws = plant(d, WORD.findall(text or ""))
        runs = every_run(ws)
        best = max(runs, key=lambda r: ((r[1] - r[0]) / r[2], -r[0], -r[2]), default=None)
        shown = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        out.append((d, len(runs), *shown, sha("".join(f"{s},{e - s},{p}\n" for s, e, p in runs)), sha(collapsed(ws, runs))))
    return sorted(out, key=repr)


def strings():
    rng = random.Random(13)
    yield from ("a" * n for n in range(1, 12))
    yield "ab" * 9 + "a" + "ab" * 5
    yield ("aab" * 4 + "c") * 9  # runs inside a run
    yield "aaaaaabaaaaaabaaaaaabaaaaaab"
    fib = ["b", "a"]
    for _ in range(11):
        fib.append(fib[-1] + fib[-2])
    yield fib[-1] * 4
    thue = "a"
    for _ in range(9):
        thue += thue.translate({97: 98, 98: 97})
    yield thue + thue * 3
    for _ in range(400):
        unit = "".join(rng.choice("ab" if rng.random() < 0.5 else "abcd") for _ in range(rng.randint(1, 12)))
        parts = [rng.choice([unit * rng.randint(1, 8), "a" * rng.randint(0, 9), "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))]) for _ in range(rng.randint(1, 9))]
        yield "".join(parts) * rng.choice([1, 1, 2, 5])


def test_runs_of_strings():
    for s in strings():
        t = np.append(np.frombuffer(s.encode(), np.uint8).astype(np.int64), 1000)
        assert sorted(periodic.runs_of(t), key=lambda r: (r[0], r[2])) == every_run(list(s)), s


def test_previous_factors():
    for s in [*strings()][:80]:
        t = np.append(np.frombuffer(s[:60].encode(), np.uint8).astype(np.int64), 1000)
        names = periodic.Names(t)
        assert names.suffixes.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        common = np.append(0, names.forward(names.suffixes[:-1], names.suffixes[1:]))
        size, source = periodic.previous_factors(names.suffixes, common)
        x = t.tolist()
        for i in range(len(x)):
            best = max((next(k for k in range(len(x)) if i + k == len(x) or x[j + k] != x[i + k]) for j in range(i)), default=0)
            assert size[i] == best
            assert not best or source[i] < i and x[source[i] : source[i] + best] == x[i : i + best]


LONG = " ".join(f"w{i % 97}" for i in range(120_000))
ROWS = [
    (1, "a a a a a a"), (2, "a a a a a"), (3, None), (4, ""), (5, " \n\t "), (6, "x y " * 4), (None, "no id " * 8), (7, "no id " * 8), (7, "no id " * 8),
    (8, ("one two three " * 5 + "four ") * 6), (9, "A a A a A a A a"), (10, "é\x00ö é\x00ö " * 5), (11, LONG), (12, "tail " * 7 + "end"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, " + EXTRA).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [40, 500_000])
def test_awkward_rows(spark, monkeypatch, size):
    found = {}
    for r in periodic.find_runs(frame(spark, ROWS)).collect():
        found.setdefault((r.doc_id, r.n_words), []).append(([(x.start, x.start + x.length, x.period) for x in r.runs], r.collapsed))
    for d, text in ROWS:
        ws = WORD.findall(text or "")
        runs = every_run(ws) if len(ws) < 5000 else [(0, len(ws), 97)]
        assert (runs, collapsed(ws, runs)) in found[d, len(ws)]
    assert sum(map(len, found.values())) == len(ROWS)


def test_empty(spark):
    assert periodic.find_runs(frame(spark, [])).collect() == []


def test_query_on_awkward_rows(spark, tmp_path):
    rows = [(d, t) for d, t in ROWS if d != 11]
    rng = random.Random(4)
    rows += [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 90)))) for i in range(20, 320)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op13_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert rows_of(df) == contract(rows)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(queries.op13_periodic_runs(spark, SF))
    assert got == contract(rows)
    assert sum(r[1] > 0 for r in got) > len(rows) // 20
    assert re.fullmatch("[0-9a-f]{64}", got[0][-1])
