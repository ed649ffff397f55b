"""Whitening of embeddings from an exact integer scatter.

An entry c becomes the integer x = floor(64 * c) + 1,000,000. The model is fitted on each distinct x vector
once: n vectors with sums S. Tasks subtract a shift (one of the vectors, so that what is left is small),
cut what is left into signed digits of 20 bits and multiply digit matrices of at most ``ROWS`` rows in
float64, where every partial sum is an integer below 2 ** 53 and so exact; the products are added up as
integers of any size. A task gives its totals as 32-bit limbs, which Spark adds up by (row, column, limb):
exact whatever the number of rows or the order of additions. The scatter n * X'X - SS' is formed in integers,
and only then becomes floating-point numbers and is decomposed by eigh.

eigh's error is relative to the largest eigenvalue. Where the spread is large, that is too much for the
small ones; so the decomposition is polished: in extended precision, the scatter in the basis of eigh's
vectors is almost diagonal, and what is left beside the diagonal is rotated away (Jacobi). Components whose
eigenvalue is not above rounding (``RANK`` times the dimension times the largest) can't be told from none and
are not given.

The driver holds the scatter of d x d entries, and a model of d x 16: their size is that of the
dimension and has nothing to do with the number of rows. What whitening achieved is measured on the whitened fit list itself.

Defined results: rows whose vector is null, empty, holds a null or a non-finite entry, or one of 2 ** 55 or more (whose x
isn't exact) are dropped; so are those of another dimension than the most frequent one (the larger on a
tie), which lie in another space; null and repeated ids are rows like others; equal vectors count once in the fit and
each get a result; a table with one distinct vector has no component, so no row; ``deviation`` is exact up to
38 digits and null beyond; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import stage
from quire.llm.vec import release

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 55)
COMPONENTS = 16
#: Bits of a digit, and rows of a product: (2 ** 19) ** 2 * 2 ** 14 = 2 ** 52.
DIGIT, ROWS = 20, 1 << 14
LIMB = 32
RANK = 1e-17


def codes(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that remain."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    rows = embeddings.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    rows = rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE) + OFFSET).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (most.d if most else 0))


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed digits of integers (int64, or Python's in an object array), lowest first, as float64."""
    half, mask, out = 1 << (DIGIT - 1), (1 << DIGIT) - 1, []
    while y.any():
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    return out


def _whole(a: np.ndarray) -> np.ndarray:
    """Exact floats as Python's integers."""
    return a.astype(np.int64).astype(object)


def totals(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the rows of y, as Python's integers."""
    d = y.shape[1]
    s, c = np.zeros(d, object), np.zeros((d, d), object)
    for a in range(0, len(y), ROWS):
        parts = digits(y[a : a + ROWS])
        for i, p in enumerate(parts):
            s += _whole(p.sum(0)) << (DIGIT * i)
            for j, q in enumerate(parts):
                c += _whole(p.T @ q) << (DIGIT * (i + j))
    return s, c


def squares(t: np.ndarray) -> np.ndarray:
    """Exact sums of squares of each row, as Python's integers."""
    parts, out = digits(t), np.zeros(len(t), object)
    for i, p in enumerate(parts):
        for j, q in enumerate(parts):
            out += _whole(np.einsum("ij,ij->i", p, q)) << (DIGIT * (i + j))
    return out


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _limbs(values: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    sign, rest, k = np.where(values < 0, -1, 1), np.abs(values), 0
    while rest.any():
        part = (rest & ((1 << LIMB) - 1)).astype(np.int64) * sign.astype(np.int64)
        some = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array(i[some], pa.int32()), pa.array(j[some], pa.int32()), pa.array(np.full(len(some), k), pa.int32()), pa.array(part[some])], ["i", "j", "k", "part"])
        rest, k = rest >> LIMB, k + 1


def scatter(vectors: DataFrame, shift: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, exact sums and exact cross-products of the vectors ``x`` less the shift."""
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            y = matrix(batch.column(0), d) - shift
            more = totals(y)
            n, s, c = n + len(y), s + more[0], c + more[1]
        i, j = np.triu_indices(d)
        values = np.concatenate([np.array([n], object), s, c[i, j]])
        row, at = np.concatenate([[-2], np.full(d, -1), i]), np.concatenate([[0], np.arange(d), j])
        yield from _limbs(values, row, at)
        release()

    parts = vectors.select("x").mapInArrow(run, "i int, j int, k int, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part"))
    n, s, c = 0, np.zeros(d, object), np.zeros((d, d), object)
    for r in parts.collect():  # d * d entries of a few limbs, whatever the number of rows
        value = r.part << (LIMB * r.k)
        if r.i == -2:
            n += value
        elif r.i == -1:
            s[r.j] += value
        else:
            c[r.i, r.j] += value
    i, j = np.triu_indices(d)
    c[j, i] = c[i, j]
    return n, s, c


def decompose(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance a / n ** 2 of exact integers a,
    in extended precision; only those above rounding."""
    d, nn = len(a), n * n
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v = a[i, j] / nn  # the nearest double
            high[i, j] = high[j, i] = v
            low[i, j] = low[j, i] = float(Fraction(a[i, j], nn) - Fraction(v))
    _, q = np.linalg.eigh(high)
    v = high.astype(np.longdouble) + low
    q = q[:, ::-1].astype(np.longdouble)
    q = q @ (1.5 * np.eye(d, dtype=np.longdouble) - 0.5 * (q.T @ q))
    b = q.T @ v @ q
    tiny = RANK * d * max(float(np.trace(v)), 0.0)
    for _ in range(20):
        e = np.diag(b)
        real = np.sqrt(np.where(e > tiny, e, np.inf))
        off = np.triu(np.abs(b) > 1e-15 * np.outer(real, real), 1) & np.isfinite(np.outer(real, real))
        if not off.any():
            break
        for i, j in np.argwhere(off):
            b, q = _rotated(b, q, i, j)
    e = np.diag(b)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > tiny]
    q = q[:, order]
    top = q[np.argmax(np.abs(q), 0), np.arange(q.shape[1])]
    return e[order], q * np.where(top < 0, -1, 1)


def _rotated(b: np.ndarray, q: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """b and q with the entry (i, j) of b rotated to zero."""
    if b[i, j] == 0:
        return b, q
    theta = (b[j, j] - b[i, i]) / (2 * b[i, j])
    t = (1 if theta >= 0 else -1) / (abs(theta) + np.sqrt(theta * theta + 1))
    c = 1 / np.sqrt(t * t + 1)
    turn = np.array([[c, t * c], [-t * c, c]], np.longdouble)
    b[[i, j], :] = turn.T @ b[[i, j], :]
    b[:, [i, j]] = b[:, [i, j]] @ turn
    q[:, [i, j]] = q[:, [i, j]] @ turn
    return b, q


@dataclass
class Model:
    """What whitens a vector x: n, the shift, the sums of what is left, and the components over the roots of
    their eigenvalues (columns)."""

    n: int
    shift: np.ndarray
    sums: np.ndarray
    project: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit integers where all fit, Python's where not."""
        y = x - self.shift
        far = int(np.abs(y).max(initial=0)) * self.n + max((abs(v) for v in self.sums), default=0)
        return y * self.n - self.sums.astype(np.int64) if far < 1 << 62 else y.astype(object) * self.n - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.project


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors ``x``; nothing if there are none."""
    first = vectors.agg(F.min("x")).first()[0]
    if first is None:
        return None
    shift = np.array(first, np.int64)
    n, s, c = scatter(vectors, shift)
    a = n * c - np.outer(s, s)
    e, q = decompose(a, n)
    e, q = e[:components], q[:, :components]
    trace = Fraction(sum(a.diagonal()), n * n)
    return Model(n, shift, s, (q / np.sqrt(e)).astype(np.float64), [float(Fraction(float(v)) / trace) for v in e])


def identity_error(vectors: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, as measured."""
    d, m = model.project.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, c = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            z = model.whitened(model.centred(matrix(batch.column(0), d)))
            s, c = s + z.sum(0), c + z.T @ z
        i, j = np.indices((m, m)).reshape(2, -1)
        row, at = np.concatenate([np.full(m, -1), i]), np.concatenate([np.arange(m), j])
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(at, pa.int32()), pa.array(np.concatenate([s, c.ravel()]))], ["i", "j", "part"])
        release()

    mean, cov = np.zeros(m), np.zeros((m, m))
    for r in vectors.select("x").mapInArrow(run, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("part")).collect():
        if r.i < 0:
            mean[r.j] = r.part / model.n
        else:
            cov[r.i, r.j] = r.part / model.n
    return float(np.abs(cov - np.outer(mean, mean) - np.eye(m)).max(initial=0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``, a row each vector that remains: n of the
    fit, the exact sum of (n * x - S) ** 2, and arrays with an entry for each component, the first the
    strongest."""
    rows = codes(embeddings)
    distinct = stage(rows.select("x").distinct(), "whiten-fit")
    model = fit(distinct, components)
    if model is None:
        model, error = Model(0, np.zeros(1, np.int64), np.zeros(1, object), np.zeros((1, 0)), []), 0.0
    else:
        error = identity_error(distinct, model)
    d, most = len(model.shift), 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = model.centred(matrix(batch.column(1), d))
            z = model.whitened(t)
            far = pa.array([Decimal(v) if v < most else None for v in squares(t)], pa.decimal128(38, 0))
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), far, whitened], ["vec_id", "deviation", "whitened"])
        release()

    found = rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(v) for v in model.explained]).cast("array<double>")
    return found.select("vec_id", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
