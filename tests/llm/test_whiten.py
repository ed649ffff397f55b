"""Whitening against a plain version in exact fractions and extended precision."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import queries, whiten

SF = "/root/testdata/sf0.001"
EXTRA = "x string, n int, deviation double"


def plain(rows, m=16):
    """{(vec_id, x): (n, deviation, {component: |whitened|}, {component: explained})} from the contract."""
    code = lambda v: tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)
    good = [(i, code(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    t = lambda x: [n * x[k] - s[k] for k in range(d)]
    cov = np.array([[float(Fraction(sum(t(x)[i] * t(x)[j] for x in fit), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = []
    for i, x in good:
        dev = sum(v * v for v in t(x))
        for k in range(min(m, d)):
            if e[k] > 1e-9 * e[0]:
                w = sum(float(Fraction(v, n)) * q[j, k] for j, v in enumerate(t(x))) / math.sqrt(e[k])
                out.append((i, k + 1, n, dev, abs(w), e[k] / np.trace(cov)))
    return sorted(out, key=repr)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, {EXTRA}").repartition(3)


def table(found):
    """Rows as in the contract, of the general result."""
    return sorted(((r.vec_id, k + 1, r.n, int(r.deviation), abs(w), r.explained[k]) for r in found.collect() for k, w in enumerate(r.whitened)), key=repr)


def close(a, b, rel=1e-9):
    assert len(a) == len(b) > 0
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=rel, abs_tol=1e-7) and math.isclose(x[5], y[5], rel_tol=1e-6), (x, y)


def some(n, d, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(c)) for c in rng.normal(size=d) * np.arange(1, d + 1)]) for i in range(n)]


def test_awkward_rows(spark):
    rows = some(80, 5)
    rows += [(200, rows[0][1]), (None, rows[1][1]), (3, rows[3][1])] + [(300 + i, rows[0][1]) for i in range(50)]  # copies, null and repeated ids
    bad = [(400, None), (401, []), (402, [1.0, None, 1.0, 1.0, 1.0]), (403, [1.0, math.nan, 1.0, 1.0, 1.0]), (404, [math.inf] * 5), (405, [1.0, 2.0]), (406, [1e30] * 5)]
    found = whiten.whiten(frame(spark, rows + bad))
    close(table(found), plain(rows))
    assert found.first().identity_error < 1e-10
    assert {r.vec_id for r in found.collect()}.isdisjoint(i for i, _ in bad)


def test_sizes_without_components(spark):
    assert whiten.whiten(frame(spark, [])).collect() == []
    only = whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.whitened, int(r.deviation)) for r in only] == [(1, [], 0)] * 2


def test_rank(spark):
    """A dimension that is the sum of others, and a constant one, add no component."""
    rows = [(i, [v[0], v[1], float(round(64 * v[0]) + round(64 * v[1])) / 64, 7.0]) for i, v in some(60, 2)]
    rows = [(i, [round(64 * a) / 64, round(64 * b) / 64, c, e]) for i, (a, b, c, e) in rows]
    found = whiten.whiten(frame(spark, rows, "double"))
    assert all(len(r.whitened) == 2 for r in found.collect()) and found.first().identity_error < 1e-9


def test_wide_spread(spark):
    """Eigenvalues over 12 orders of magnitude: each to its own relative precision, in any rotation."""
    rng = np.random.default_rng(7)
    scale = np.array([3e4, 2e3, 5.0, 0.5, 0.05])
    turn, _ = np.linalg.qr(rng.normal(size=(5, 5)))
    rows = [(i, [float(c) for c in (rng.normal(size=5) * scale) @ turn]) for i in range(400)]
    found = whiten.whiten(frame(spark, rows, "double")).collect()
    assert len(found) == 400 and len(found[0].whitened) == 5
    assert found[0].identity_error < 1e-6
    z = np.array([r.whitened for r in found])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(5)).max() < 1e-6


def test_huge_entries_stay_exact(spark):
    """Beyond 64 bits in n * x - S and its squares."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(rng.integers(-(2**54), 2**54)), float(rng.integers(-9, 9))]) for i in range(40)]
    found = {r.vec_id: r.deviation for r in whiten.whiten(frame(spark, rows, "double")).collect()}
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    want = {i: sum((40 * x[k] - sum(y[k] for y in xs)) ** 2 for k in (0, 1)) for (i, _), x in zip(rows, xs, strict=True)}
    assert {i: v if v is None else int(v) for i, v in found.items()} == {i: v if v < 10**38 else None for i, v in want.items()}


@pytest.mark.parametrize("kind", [np.int64, object])
def test_totals_are_exact(kind):
    rng = np.random.default_rng(1)
    y = rng.integers(-(2**61), 2**61, (50, 4)).astype(kind)
    s, c = whiten.totals(y)
    rows = [[int(v) for v in r] for r in y]
    assert list(s) == [sum(r[k] for r in rows) for k in range(4)]
    assert all(c[i, j] == sum(r[i] * r[j] for r in rows) for i in range(4) for j in range(4))
    assert list(whiten.squares(y)) == [sum(v * v for v in r) for r in rows]


def test_query(spark):
    df = queries.op12_embedding_whitening(spark, SF)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()), key=repr)
    close(got, plain(rows), rel=1e-7)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert df.agg({"identity_error": "max"}).first()[0] < 1e-10
