"""Line dedup by pairwise alignment.

Documents are in order of (doc_id, text hash). A document whose whole text stands in an earlier one is
deleted wholly. Of each remaining text, every run of 1, 2, 4, 8, ... lines that holds a word is a unit. A unit
is rare if at most ``RARE`` documents hold it: all of them are partners of each other. A more frequent unit
makes its holders partners of its owner, the first of them, so that each shared block, and not only each
shared line, has an owner to be aligned with. That is at most RARE pairs for a unit of a document, however
many documents share a line. Each pair is aligned by patience diff (lines that occur once in both, longest
increasing run of their places, extended over equal neighbours and refined between them), and the aligned
lines are deleted from the later document.

Since deleting is judged on the input, the result doesn't depend on the order of work. No line is
deleted that a patience diff with some earlier document doesn't align. A block of more than RARE holders can
stay: if the alignment with each of the first holders of its units leaves it out, though a later holder
would be aligned with it. Whole texts are told apart by 128 bits of hash, lines by 64 bits, which are
compared within a pair only: an expected n * m / 2^64 false matches for a pair of n and m lines.

Partners of a document that very many pair with are dealt out by salt, its lines being sent once for each.

Defined results: null and empty texts have no lines and pair with nothing; lines of white space make no
unit of their own, but are deleted if they stand between two aligned lines; a null id comes after all
others; equal rows (same id and text) count as one document and get the same result; a copy of a whole
text has one partner, the first document with that text; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import small, stage
from quire.llm.vec import U, mix, release

#: Pairs and documents that are worked on at a time.
SLICE = 64
#: Documents that a unit pairs all with all; partners of one document for each salt.
RARE, SALT = 16, 128
AT = "none boolean, id bigint, text_key bigint"


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two sequences, in order: patience diff, refined between the anchors."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1}
        pairs = [(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and x in place]
        anchors = _longest_increasing(pairs)
        last_a, last_b = a0, b0
        for i, j in anchors:
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i, j
        if anchors:
            todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first place, the longest run whose second places increase."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j), at.append(k)
        else:
            tops[pile], at[pile] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct runs of 1, 2, 4, ... lines of each document that hold a word, as hashes."""
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            batch = whole.slice(a, SLICE)
            h = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(U)
            worded = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(bool)
            size = batch.column(3).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            left = np.repeat(np.cumsum(size), size) - np.arange(len(row))  # lines from a place to its text's end
            rows, units, span = [row[worded]], [h[worded]], 1
            while (left >= 2 * span).any():
                n = len(h) - span
                h, worded = mix(h[:n] + mix(h[span:] + U(span))), worded[:n] | worded[span:]
                span *= 2
                good = worded & (left[:n] >= span)
                rows.append(row[:n][good]), units.append(h[good])
            both = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(units).view(np.int64)], names="row,unit"))
            keys = [batch.column(i).take(pa.array(both["row"])) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.ascontiguousarray(both["unit"]))], names=["none", "id", "text_key", "unit"])


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            batch = whole.slice(a, SLICE)
            later, owner = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            gone = [[j for _, j in patience(o, d)] for o, d in zip(owner, later, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(gone, pa.list_(pa.int32()))], names=["none", "id", "text_key", "gone"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_partners, text (without the deleted lines) of every document."""
    at = F.struct(F.isnull("doc_id").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("doc_id", "text").alias("text_key"))
    keyed = docs.select("doc_id", at.alias("at"), "text")
    lines = F.split(F.col("text"), "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(r"[^\x20\x09-\x0D]").alias("worded")))
    whole = F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))  # 128 bits: all lines go by it
    own = stage(keyed.where(F.length("text") > 0).select("at", whole.alias("whole"), hashed.alias("lines")), "line-hashes")
    wholes = own.groupBy("whole").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    wholes = stage(wholes.where("n > 1").select("whole", "first"), "line-wholes")
    copy = F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    marked = own.join(wholes, "whole", "left").withColumn("copy", copy)
    copies = marked.where("copy").select("at").distinct()
    firsts = marked.where("not copy").select("at", F.col("lines.h").alias("seq"), F.col("lines.worded").alias("worded"))
    firsts = stage(firsts.dropDuplicates(["at"]), "line-firsts")
    key = F.struct("none", "id", "text_key").alias("at")
    units = firsts.select("at.*", "seq", "worded").mapInArrow(_units, f"{AT}, unit bigint").select(key, "unit")
    holders = units.groupBy("unit").agg(F.min("at").alias("owner"), F.count("*").alias("n"))
    shared = stage(units.join(holders.where("n > 1"), "unit"), "line-shared")
    frequent = shared.where((F.col("n") > RARE) & (F.col("owner") < F.col("at"))).select("at", "owner")
    rare = shared.where(F.col("n") <= RARE).groupBy("unit").agg(F.array_sort(F.collect_list("at")).alias("all")).select("all").distinct()
    earlier = F.transform("all", lambda x, i: F.transform(F.slice("all", F.lit(1), i), lambda y: F.struct(x.alias("at"), y.alias("owner"))))
    rare = rare.select(F.explode(F.flatten(earlier)).alias("x")).select("x.at", "x.owner")
    pairs = stage(frequent.unionByName(rare).distinct(), "line-pairs")
    of_owner = stage(pairs.groupBy("owner").agg(F.ceil(F.count("*") / SALT).cast("int").alias("n_salts")), "line-partners")
    salted = pairs.join(small(of_owner), "owner").select("at", "owner", F.pmod(F.xxhash64("at"), "n_salts").cast("int").alias("salt"))
    with_own = salted.join(firsts.select("at", F.col("seq").alias("later")), "at")
    owners = firsts.select(F.col("at").alias("owner"), F.col("seq").alias("earlier")).join(small(of_owner), "owner")
    owners = owners.select("owner", "earlier", F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"))
    both = with_own.join(owners, ["owner", "salt"])
    gone = both.select("at.*", "later", "earlier").mapInArrow(_align, f"{AT}, gone array<int>").select(key, "gone")
    gone = gone.groupBy("at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.count("*").alias("n_partners"))
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.select("at", F.array().cast("array<int>").alias("gone"), F.lit(1).cast("long").alias("n_partners"), F.lit(True).alias("copy")))
    out = keyed.join(gone, "at", "left")
    n = F.when(F.length("text") > 0, F.size(lines)).otherwise(0)
    gone, copy = F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("copy", F.lit(False))
    stay = F.array_except(F.transform(lines, lambda x, i: i), gone)  # by a set: linear in the lines
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    kept = F.when(copy, F.lit("")).when(F.size(gone) == 0, F.coalesce("text", F.lit(""))).otherwise(kept)
    deleted = F.when(copy, n).otherwise(F.size(gone))
    return out.select("doc_id", n.cast("long").alias("n_lines"), deleted.cast("long").alias("n_deleted"), F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"), kept.alias("text"))
