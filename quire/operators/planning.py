"""Chunks of work from ordered segments: semantic units, packed greedily under two budgets, in column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.sequence import pack, running
from quire.sources.scratch import stage

#: Types whose neighbours make a run, beside dialogue.
RUNS = ("LIST_ITEM", "QUOTE", "POETRY")


def units(segments: DataFrame, *, target: int = 6000, most: int = 40) -> DataFrame:
    """Semantic units: chapter_id, unit (in order), n_segments, chars, segment_ids, titled.

    Neighbouring list items, quotes, verses or lines of dialogue make a run, and runs are cut greedily by
    the budgets; other segments stand alone; a title takes the unit after it, if both fit. ``segment_order`` is a whole
    number, so that blocks of a chapter come from it, without a sort of all segments."""
    kind = F.col("segment_type")
    run = F.when(kind.isin(*RUNS), kind).when((kind == "PARAGRAPH") & F.col("dialogue"), "dialogue")
    s = segments.select("chapter_id", "segment_order", "segment_id", F.length("source_text").alias("chars"), "segment_type", T.is_dialogue(F.col("source_text")).alias("dialogue"))
    s = s.select("chapter_id", "segment_order", "segment_id", "chars", (kind == "TITLE").alias("title"), run.alias("run"), F.lit(1).alias("one"))
    s = running(s, ["chapter_id"], "segment_order", sums={"i": F.lit(1)}, before={"run_before": F.col("run")})
    same = F.coalesce(F.col("run") == F.col("run_before"), F.lit(False))
    s = pack(s.withColumn("i", F.col("i") - 1), ["chapter_id"], "i", "one", "chars", most=most, target=target, forced=~same)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("i", "segment_id"))), lambda x: x["segment_id"])  # most at most
    u = s.groupBy("chapter_id", F.col("piece").alias("unit")).agg(F.count("*").alias("n_segments"), F.sum("chars").alias("chars"), ids.alias("segment_ids"), F.bool_or("title").alias("title"))
    u = running(u, ["chapter_id"], "unit", before={"title_before": F.col("title"), "chars_before": F.col("chars")})
    fits = (F.col("n_segments") + 1 <= most) & (F.col("chars_before") + F.col("chars") <= target)
    taken = F.coalesce(F.col("title_before") & ~F.col("title") & fits, F.lit(False))
    u = u.withColumn("unit", F.col("unit") - taken.cast("int"))
    both = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("title")).alias("later"), "segment_ids"))), lambda x: x["segment_ids"]))
    return u.groupBy("chapter_id", "unit").agg(F.sum("n_segments").alias("n_segments"), F.sum("chars").alias("chars"), both.alias("segment_ids"), F.bool_or("title").alias("titled"))


def chunk_plan(segments: DataFrame, *, target: int = 6000, most: int = 40) -> DataFrame:
    """One row a chunk: chapter_id, chunk (from 0 on in a chapter), n_segments, chars, segment_ids in order. A
    unit with a title begins a chunk."""
    u = pack(units(segments, target=target, most=most), ["chapter_id"], "unit", "n_segments", "chars", most=most, target=target, forced=F.col("titled"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "segment_ids"))), lambda x: x["segment_ids"]))
    return u.groupBy("chapter_id", F.col("piece").alias("chunk")).agg(F.sum("n_segments").alias("n_segments"), F.sum("chars").alias("chars"), ids.alias("segment_ids"))


def context_window(segments: DataFrame, k: int = 4) -> DataFrame:
    """For every translated segment, the ids of the k translated ones before it in its chapter."""
    w = Window.partitionBy("chapter_id").orderBy("segment_order").rowsBetween(-k, -1)
    done = segments.where((F.col("status") == "TRANSLATED") & (F.trim("translated_text") != ""))
    return done.select("segment_id", F.collect_list("segment_id").over(w).alias("context"))


def chunk_context(chunks: DataFrame, segments: DataFrame, k: int = 4) -> DataFrame:
    """For every chunk, the ids of the last k translated segments of its chapter before it; none are its own.
    Translated segments are numbered, and a chunk asks for k numbers: nothing grows with the chapter."""
    w = Window.partitionBy("chapter_id").orderBy("segment_order").rowsBetween(Window.unboundedPreceding, 0)
    done = F.coalesce((F.col("status") == "TRANSLATED") & (F.trim("translated_text") != ""), F.lit(False))
    numbered = segments.select("chapter_id", "segment_id", done.alias("done"), F.sum(done.cast("int")).over(w).alias("number"))
    first = stage(chunks.select("chapter_id", "chunk", F.element_at("segment_ids", 1).alias("segment_id")), "first")  # read twice
    upto = first.join(numbered, ["chapter_id", "segment_id"]).select("chapter_id", "chunk", (F.col("number") - F.col("done").cast("int")).alias("upto"))
    asked = upto.where("upto > 0").select("chapter_id", "chunk", F.explode(F.sequence(F.greatest(F.col("upto") - (k - 1), F.lit(1)), F.col("upto"))).alias("number"))
    found = asked.join(numbered.where("done").select("chapter_id", "number", "segment_id"), ["chapter_id", "number"])
    lists = found.groupBy("chapter_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("number", "segment_id"))).alias("x"))
    lists = lists.select("chapter_id", "chunk", F.transform("x", lambda x: x["segment_id"]).alias("context"))
    return first.select("chapter_id", "chunk").join(lists, ["chapter_id", "chunk"], "left").select("chapter_id", "chunk", F.coalesce("context", F.array().cast("array<bigint>")).alias("context"))


def chunk_segments(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """A chunk's segments by position; ids without a segment are marked as missing."""
    ids = chunks.select("chapter_id", "chunk", F.posexplode("segment_ids").alias("position", "segment_id"))
    texts = segments.select("segment_id", "source_text", F.lit(True).alias("there"))
    return ids.join(texts, "segment_id", "left").select("chapter_id", "chunk", "position", "segment_id", "source_text", F.col("there").isNull().alias("missing"))


def part_sequence_check(parts: DataFrame) -> DataFrame:
    """Whether each segment's parts are numbered 0 to n - 1, all saying n; a lone part may have no numbers."""
    i, n = F.col("part_index"), F.col("part_count")
    g = parts.groupBy("segment_id").agg(
        F.count("*").alias("n_parts"), F.count(i).alias("with_index"), F.count(n).alias("with_count"), F.count_distinct(i).alias("different"),
        F.min(i).alias("low"), F.max(i).alias("high"), F.min(n).alias("least"), F.max(n).alias("most"),
    )
    every = F.col("n_parts")
    numbered = (F.col("with_index") == every) & (F.col("with_count") == every) & (F.col("different") == every) & (F.col("low") == 0) & (F.col("high") == every - 1) & (F.col("least") == every) & (F.col("most") == every)
    bare = (F.col("with_index") == 0) & (F.col("with_count") == 0)
    return g.select("segment_id", "n_parts", F.when(bare, every == 1).otherwise(F.coalesce(numbered, F.lit(False))).alias("valid"))


def split_chunks(chunks: DataFrame, most_depth: int = 3) -> DataFrame:
    """Halves of chunks of more than one segment below the depth, the first half the larger: child_order
    is parent * 1000 + i."""
    n = F.size("segment_ids")
    half = F.ceil(n / 2).cast("int")
    halves = F.array(F.slice("segment_ids", F.lit(1), half), F.slice("segment_ids", half + 1, n - half))
    some = chunks.where((F.col("depth") < most_depth) & (n > 1))
    out = some.select("chapter_id", F.col("chunk").alias("parent"), (F.col("depth") + 1).alias("depth"), (F.col("chars") / 2).cast("long").alias("chars"), F.posexplode(halves).alias("i", "segment_ids"))
    return out.select("chapter_id", "parent", (F.col("parent") * 1000 + F.col("i")).cast("long").alias("child_order"), "depth", "chars", "segment_ids")
