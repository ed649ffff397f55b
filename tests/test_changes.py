"""The log of changes: batches in any order, late, repeated and interrupted ones, and what is rewritten."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from quire.sources import changes

KIND = "note_id long, change_id long, at timestamp_ntz, op string, actor string, admin boolean, content string"
DAY = datetime(2024, 1, 1)


def one_by_one(rows):
    """{note: (creator, content, deleted, refused)} by going through the changes in order."""
    notes = {}
    for note, _, _, op, actor, admin, content in sorted({r[:2]: r for r in rows if None not in r[:2]}.values(), key=lambda r: (r[2] or datetime.min, r[1])):
        n = notes.setdefault(note, [None, None, False, 0])
        if n[0] is None and op == "create":
            n[:2] = [actor, content]
        elif n[0] is None or n[2] or op == "create" or not (admin or actor == n[0]):
            n[3] += 1
        elif op == "update":
            n[1] = content
        else:
            n[2] = True
    return {k: tuple(v) for k, v in notes.items() if v[0] is not None}


def test_batches_in_any_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "BUCKETS", 4)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, 8]), i, DAY + timedelta(hours=rng.randint(0, 40)), rng.choice(["create", "update", "update", "update", "delete"]), rng.choice("ab"), rng.random() < 0.1, rng.choice([f"c{i}", None])) for i in range(160)]
    rows += [(None, 900, DAY, "create", "a", False, "x"), (9, None, DAY, "create", "a", False, "x"), (10, 901, None, "create", "a", None, "x"), (10, 902, DAY, "update", "b", None, "y")]
    frame = lambda some: spark.createDataFrame(some, KIND).repartition(2)
    rng.shuffle(rows)
    path, want = str(tmp_path / "notes"), one_by_one(rows)
    with monkeypatch.context() as m:  # stopped before it is published
        m.setattr(changes, "replay", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            changes.apply(frame(rows[:50]), path)
    with pytest.raises(FileNotFoundError):
        changes.notes(spark, path)
    for a in (0, 55, 110, 0):
        changes.apply(frame(rows[a : a + 55]), path)
    got = {r.note_id: (r.creator, r.content, r.deleted, r.refused) for r in changes.notes(spark, path, deleted=True).collect()}
    assert got == want and any(v[2] for v in want.values()) and any(v[3] for v in want.values())
    assert {r.note_id for r in changes.notes(spark, path).collect()} == {k for k, v in want.items() if not v[2]}
    assert len(changes.apply(frame([(1, 2000, DAY, "update", "b", True, "late")]), path)) == 1  # one bucket of four
    assert changes.apply(frame([]), path) == []
