"""Line dedup against the alignment of all pairs: reversed owners, the smallest documents, repeated rows."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import brute
from quire.llm import lines

SF = "/root/testdata/sf0.001"


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_deleted, r.text) for r in lines.dedup_lines(df).collect()), key=repr)


@pytest.mark.parametrize("salt", [128, 1])
def test_reversed_owners(spark, monkeypatch, salt):
    monkeypatch.setattr(lines, "SALT", salt)
    rows = [(1, "beta\nalpha"), (2, "alpha\nbeta\ngamma"), (3, "alpha\nbeta\ndelta"), (4, "delta\nx\ngamma"), (5, "x\ny\nx\ny"), (6, "y\nx\ny\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("seq", F.lit(1)).withColumn("at", F.lit(2))
    got = found(df)
    assert got == sorted(brute.line_dedup(rows, lines.patience), key=repr)
    assert [r[2] for r in got if r[0] == 3] == [2]


def test_smallest_documents(spark):
    """The documents of the smallest tables: as if all pairs were aligned."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = sorted(zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), strict=True), key=lambda r: r[0])
    got, want = found(df), sorted(brute.line_dedup(rows, lines.patience), key=repr)
    assert len(got) == len(want) and sum(r[2] for r in want) > 0
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert sum(r[2] for r in got) >= 0.99 * sum(r[2] for r in want)


def test_repeated_rows_and_long_texts(spark):
    long = "\n".join(f"line {i % 30000}" for i in range(40_000))
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x\na\nb"), (2, "x\na\nb"), (3, long), (4, "head\n" + long)]
    got = [r[:3] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))]
    assert got == [(1, 3, 0), (1, 3, 0), (2, 3, 2), (2, 3, 2), (3, 40_000, 0), (4, 40_001, 40_000)]
