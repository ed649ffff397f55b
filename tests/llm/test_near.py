"""Near duplicates that hubs alone don't connect, in one cell or many, whole or in blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from quire.llm import neardup


def chains(seed=2):
    """Texts that drift apart step by step, in several directions, and copies far from every hub."""
    rng = random.Random(seed)
    rows = []
    for family in range(3):
        base = [f"f{family}w{rng.randint(0, 9999)}" for _ in range(120)]
        for _ in range(6):
            words = list(base)
            for step in range(9):
                rows.append(" ".join(words))
                for _ in range(rng.randint(1, 4)):
                    words[rng.randrange(len(words))] = f"x{rng.randint(0, 99999)}"
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_chains(spark, monkeypatch, small):
    if small:  # blocks of a few classes, salts of two
        for name, value in (("BLOCK", 3), ("BLOCK_MOST", 5), ("BLOCKS", 2), ("SALT", 2)):
            monkeypatch.setattr(neardup, name, value)
    rows = chains()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("hub", F.lit(2))
    found = neardup.near_duplicates(df, k=3, percent=85).select("doc_id", "n_shingles", "component_id")
    want = sorted(brute.near(rows, 3, 85))
    assert sorted(map(tuple, found.collect())) == want
    assert 3 < len({c for _, _, c in want}) < len(rows)


def test_equal_rows_and_null_ids_when_dropping(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, a), (6, a), (None, a), (None, b), (None, b), (7, None), (7, None), (8, "")]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, a), (None, b), (7, None), (8, "")], key=repr)
