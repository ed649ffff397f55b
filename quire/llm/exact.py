"""Exact copies by progressive refinement, in DataFrame functions only.

Rows are split by length, then by a hash of their first ``PREFIX`` characters, then by a hash of the whole
text; each step looks only at rows that share their group of the step before with another row.

The first two steps need to know of a row only whether it is alone, so their groups are hashed to ``SLOTS``
slots: slots with two rows or more are one bit each, in pages of 4 KB that every task gets (4 MB at most,
whatever the input). Two groups in one slot send a few rows on to the next step in vain, and lose none:
what decides is the last step, SHA-256 of the whole normalised text. A text is never shuffled: lengths and
prefixes are read in one pass, whole texts are hashed where they lie in another, and only hashes and ids
move. Groups are counted before they move, so that a hot one is a row a task; they come back to their rows
by a broadcast of counted rows, or a join that Spark may split.

Texts are equal if they are so after lower-casing A-Z only. Of equal texts the row with the largest
``doc_id`` stays.

Defined results: a null text counts as empty; a null id is smaller than all others; of repeated rows (same
id and text) exactly one can stay, and all count in ``group_size``; extra columns are ignored by
``classes`` and kept by ``drop_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.decontam import LOWER, UPPER
from quire.llm.store import small, stage

#: Characters that the second step looks at.
PREFIX = 256
#: Slots of a step's groups, and those of one page: the bits of 4 KB.
SLOTS, PAGE = 1 << 25, 1 << 15


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _length_slot() -> Column:
    return F.octet_length("t") % SLOTS


def _prefix_slot() -> Column:
    prefix = F.translate(F.substring("t", 1, PREFIX), UPPER, LOWER)
    return F.pmod(F.xxhash64(F.octet_length("t"), prefix), F.lit(SLOTS)).cast("int")


def _pages(slots: DataFrame, slot: str) -> DataFrame:
    """Bits of the slots that two rows or more have: ``<slot>_page``, ``<slot>_bits``."""
    shared = slots.groupBy(slot).agg(F.count("*").alias("n")).where("n > 1")
    page, place = F.floor(F.col(slot) / PAGE).cast("int"), (F.col(slot) % PAGE).cast("long")
    return shared.groupBy(page.alias(f"{slot}_page")).agg(F.bitmap_construct_agg(place).alias(f"{slot}_bits"))


def _among(rows: DataFrame, pages: DataFrame, slot: str) -> DataFrame:
    """``rows`` with ``<slot>_shared``: whether another row has their slot. Pages are SLOTS / PAGE at most."""
    place = F.col(slot) % PAGE
    octet = F.conv(F.hex(F.substring(f"{slot}_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(pages), F.floor(F.col(slot) / PAGE).cast("int") == F.col(f"{slot}_page"), "left")
    return joined.withColumn(f"{slot}_shared", F.coalesce(F.getbit(octet, place % 8) == 1, F.lit(False))).drop(f"{slot}_page", f"{slot}_bits")


def classes(docs: DataFrame, row: str | None = None, digest: bool = False) -> DataFrame:
    """``doc_id, row, keep_id, group_size, kept, text_sha256``, a row each of ``docs``. ``row``: a column that
    numbers the rows, else they are numbered as they are read. The digest is that of rows whose whole text had
    to be looked at; of all, if asked for."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"))
    slots = stage(given.select(_length_slot().alias("len"), _prefix_slot().alias("pre")), "exact-slots")
    lengths = stage(_pages(slots, "len"), "exact-lengths")
    prefixes = stage(_pages(_among(slots, lengths, "len").where("len_shared"), "pre"), "exact-prefixes")

    again = _among(_among(given.withColumns({"len": _length_slot(), "pre": _prefix_slot()}), lengths, "len"), prefixes, "pre")
    look = F.col("len_shared") & F.col("pre_shared")
    sha = F.sha2(normalised(F.col("t")), 256)
    number = F.col("row") if row else F.monotonically_increasing_id()
    again = again.select("doc_id", number.alias("row"), look.alias("looked"), (sha if digest else F.when(look, sha)).alias("text_sha256"))
    rows = stage(again, "exact-rows")

    groups = rows.where("looked").groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays")).where("group_size > 1")
    groups = stage(groups.select(F.col("text_sha256").alias("of"), "group_size", "stays"), "exact-groups")
    members = rows.where("looked").join(small(groups), F.col("text_sha256") == F.col("of"), "left")
    alone = F.col("of").isNull()
    members = members.select(
        "doc_id",
        "row",
        F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("stays.row"))).alias("kept"),
        "text_sha256",
    )
    others = rows.where("not looked").select("doc_id", "row", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return members.unionByName(others)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are copies of one with a larger id, or repeat it."""
    row, taken = "row", {c.lower() for c in docs.columns}
    while row in taken:
        row += "_"
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "exact-numbered")
    gone = classes(numbered, row=row).where("not kept").select(F.col("row").alias(row))
    return numbered.join(small(stage(gone, "exact-gone")), row, "left_anti").select(docs.columns)
