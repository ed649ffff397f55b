"""Exact copies against a plain version."""

from __future__ import annotations

import os
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from brute import low, sha
from quire.llm import exact, queries

SF = "/root/testdata/sf0.001"
EXTRA = "row long, t string, len int, kept boolean, text_sha256 string"
LONG = "An opening that many texts share. " * 20
ROWS = [
    (1, "Same text"), (2, "SAME TEXT"), (7, "same text"), (7, "same text"), (3, None), (4, ""), (None, ""), (None, "same text"), (5, "ÄÖ"), (6, "äö"), (8, "Äö"),
    (9, LONG + "a"), (10, LONG + "b"), (11, LONG + "A"), (12, " "), (13, "x" * 700_000), (14, "X" * 700_000), (15, "x" * 699_999 + "y"), (16, "same  text"),
]
ROWS += [(100 + i, f"hot {i % 2}") for i in range(60)]


def plain(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        kept = ids.index(best)
        out += [(d, best, len(ids), i == kept, sha(t)) for i, d in enumerate(ids)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 1, None, "y") for r in rows], "doc_id long, text string, " + EXTRA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("slots", [1 << 25, 1 << 15])
def test_awkward_rows(spark, monkeypatch, slots):
    """Also where groups share slots: rows are looked at in vain, and the result is the same."""
    monkeypatch.setattr(exact, "SLOTS", slots)
    assert got(exact.classes(frame(spark, ROWS), digest=True)) == plain(ROWS)


def test_one_slot(spark, monkeypatch):
    monkeypatch.setattr(exact, "SLOTS", 1)
    found = exact.classes(frame(spark, ROWS))
    assert got(found) == plain(ROWS)


def test_only_survivors_are_hashed(spark):
    found = {r.doc_id: r.text_sha256 for r in exact.classes(frame(spark, ROWS)).where("doc_id is not null").collect()}
    assert found[9] == sha(low(LONG + "a")) and found[13] and found[15]  # as long as others, and begin alike
    assert found[16] is None and found[12] is None


def test_empty_and_single(spark):
    assert got(exact.classes(frame(spark, []), digest=True)) == []
    assert got(exact.classes(frame(spark, ROWS[:1]), digest=True)) == plain(ROWS[:1])


def test_drop_copies(spark):
    docs = frame(spark, ROWS)
    kept = exact.drop_copies(docs)
    assert kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((d, t) for d, t, k in _marked() if k), key=repr)


def _marked():
    """Of each group the text of the row that stays; a null and an empty text are equal."""
    seen, out = set(), []
    for d, t in sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0))):
        out.append((d, t, low(t) not in seen))
        seen.add(low(t))
    return out


def test_random_against_plain(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["", None, "a", "A", "ab", "aB", "b" * rng.randint(1, 3), "The end"])) for _ in range(300)]
    assert got(exact.classes(frame(spark, rows), digest=True)) == plain(rows)


def test_query_and_sql(spark):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    cur = con.execute(queries.OP11_SQL)
    names = [c[0] for c in cur.description]
    df = queries.op11_exact_dedup(spark, SF)
    assert df.columns == names
    assert got(df) == sorted(cur.fetchall(), key=repr)
    assert df.where("not kept").count() > 0
    assert df.agg(F.sum(F.col("kept").cast("int"))).first()[0] == df.select("text_sha256").distinct().count()
