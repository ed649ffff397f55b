"""Terminology: extraction, merging by key, conflicts, evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import terms
from quire.operators.sequence import number


# Segments that an analysis looks at, by default and at most.
LIMIT, MOST = 120, 500


def analysis_limit(asked: int | None) -> int:
    return LIMIT if asked is None else max(1, min(asked, MOST))


def blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def key(x: Column) -> Column:
    return F.lower(F.trim(x))


def first_terms(segments: DataFrame, k: int, found: Column | None = None) -> DataFrame:
    """The first k distinct terms of each book, in order of segment and place: term, category, evidence
    (mentions), first_segment_id."""
    found = T.terms(F.col("source_text")) if found is None else found
    each = segments.select("book_id", "segment_id", F.posexplode_outer(found).alias("pos", "term")).where("term is not null")
    per = each.groupBy("book_id", F.lower("term").alias("source_norm")).agg(F.min(F.struct("segment_id", "pos", "term")).alias("x"), F.count("*").alias("evidence"))
    w = Window.partitionBy("book_id").orderBy("x.segment_id", "x.pos")
    per = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    category = F.when(F.instr("x.term", " ") > 0, "proper_noun_phrase").otherwise("proper_noun")
    return per.select("book_id", "source_norm", F.col("x.term").alias("term"), category.alias("category"), "evidence", F.col("x.segment_id").alias("first_segment_id"), "rank")


def _clean(glossary: DataFrame) -> DataFrame:
    """Rows with a term, in normal form; what is blank is null. ``pos`` is their order, 1 for each where it isn't given."""
    g = glossary.where(blank(F.col("source_term")).isNotNull())
    pos = F.col("pos") if "pos" in glossary.columns else F.lit(1)
    return g.select(key(F.col("source_term")).alias("k"), F.trim("source_term").alias("source_term"), blank(F.col("target_term")).alias("target_term"), blank(F.col("category")).alias("category"), pos.alias("pos"))


def _first(glossary: DataFrame) -> DataFrame:
    """The first row of each key."""
    return _clean(glossary).groupBy("k").agg(F.min(F.struct("pos", "source_term", "target_term", "category")).alias("x")).select("k", "x.source_term", "x.target_term", "x.category")


def merge(existing: DataFrame, incoming: DataFrame, mode: str = "FILL_EMPTY") -> DataFrame:
    """A row a key: source_norm, source_term, target_term, category, and how many incoming rows added, updated, filled or
    contradicted it (0 or more each). Of existing rows with one key the first holds; incoming ones come in order of ``pos``,
    one after another. FILL_EMPTY keeps what is there and fills what is blank; OVERWRITE takes each row whole, so that the last holds.

    Rows of a key are added up, never held together: what fills is the first that is not blank, and what
    contradicts is another than that; for OVERWRITE each row is given the one before it by ``number``."""
    has = lambda c: F.col(c).isNotNull()
    old = _first(existing).select("k", *[F.col(c).alias(f"a_{c}") for c in ("source_term", "target_term", "category")])
    new = _clean(incoming)
    if mode == "OVERWRITE":
        rows = number(new, ["k"], F.col("pos"), name="i", before={f"b_{c}": F.col(c) for c in ("source_term", "target_term", "category")})
        rows = rows.join(old, "k", "left")
        before = {c: F.when(F.col("i") == 1, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) for c in ("source_term", "target_term", "category")}
        added = (F.col("i") == 1) & ~has("a_source_term")
        changed = ~added & ~(before["source_term"].eqNullSafe(F.col("source_term")) & before["target_term"].eqNullSafe(F.col("target_term")) & before["category"].eqNullSafe(F.col("category")))
        against = F.coalesce(~added & (before["target_term"] != F.col("target_term")), F.lit(False))
        last = F.max(F.struct("i", "source_term", "target_term", "category")).alias("x")
        per = rows.groupBy("k").agg(last, F.count_if(added).alias("added"), F.count_if(changed).alias("updated"), F.lit(0).cast("long").alias("filled"), F.count_if(against).alias("conflicts"))
        per = per.select("k", *[F.col(f"x.{c}").alias(c) for c in ("source_term", "target_term", "category")], "added", "updated", "filled", "conflicts")
    else:
        at = lambda c: F.min(F.when(has(c), F.struct("pos", c))).alias(f"n_{c}")
        per = new.groupBy("k").agg(F.min("pos").alias("first"), at("source_term"), at("target_term"), at("category")).join(old, "k", "left")
        fresh = ~has("a_source_term")
        fills = {c: F.when(~has(f"a_{c}"), F.col(f"n_{c}.pos")) for c in ("target_term", "category")}
        fills = F.array_distinct(F.filter(F.array_compact(F.array(*fills.values())), lambda p: ~fresh | (p != F.col("first"))))
        value = lambda c: F.coalesce(F.col(f"a_{c}"), F.col(f"n_{c}.{c}")).alias(c)
        per = per.select("k", value("source_term"), value("target_term"), value("category"), fresh.cast("long").alias("added"), F.lit(0).cast("long").alias("updated"), F.size(fills).cast("long").alias("filled"))
        held = per.select("k", F.col("target_term").alias("held"))
        against = new.join(held, "k").where(F.col("target_term") != F.col("held")).groupBy("k").agg(F.count("*").alias("conflicts"))
        per = per.join(against, "k", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0)).cast("long"))
    none = F.lit(0).cast("long")
    kept = old.join(per.select("k"), "k", "left_anti").select("k", F.col("a_source_term").alias("source_term"), F.col("a_target_term").alias("target_term"), F.col("a_category").alias("category"), *[none.alias(c) for c in ("added", "updated", "filled", "conflicts")])
    return per.unionByName(kept).withColumnRenamed("k", "source_norm")


def conflicts(drafts: DataFrame, configured: DataFrame) -> DataFrame:
    """Drafts whose target differs from the configured one (the first of its key)."""
    c = _first(configured).select(F.col("k").alias("source_norm"), F.col("target_term").alias("configured_target"))
    d = _clean(drafts).select(F.col("k").alias("source_norm"), "source_term", "target_term")
    return d.join(c, "source_norm").where("target_term is not null and configured_target is not null and target_term <> configured_target")


def upsert(candidates: DataFrame, drafts: DataFrame) -> DataFrame:
    """Evidence adds up; first values stay, empty ones are filled. Both sides: book_id, source_norm,
    target_term, evidence, first_segment_id."""
    a, b = candidates.alias("a"), drafts.alias("b")
    both = a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("a.source_norm") == F.col("b.source_norm")), "full_outer")
    first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    total = F.coalesce("a.evidence", F.lit(0)) + F.coalesce("b.evidence", F.lit(0))
    return both.select(first("book_id"), first("source_norm"), first("target_term"), total.cast("long").alias("evidence"), first("first_segment_id"))


def counters(merged: DataFrame, incoming: DataFrame) -> DataFrame:
    """What a merge has added, updated, filled and left in conflict, and the incoming rows without a term."""
    n = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("added", "updated", "filled", "conflicts")])
    return n.crossJoin(incoming.agg(F.count_if(blank(F.col("source_term")).isNull()).alias("skipped")))  # a row each


def effective(configured: DataFrame, accepted: DataFrame) -> DataFrame:
    """Configured terms, which hold for all books (book_id null), with each book's accepted candidates
    (book_id, source_norm, term, target_term) where no configured term of the key has a target."""
    c = _first(configured).select(F.col("k").alias("source_norm"), "source_term", "target_term")
    known = c.select("source_norm", F.col("source_term").alias("name"), F.col("target_term").alias("has"))
    more = accepted.join(known, "source_norm", "left").where("has is null")
    more = more.select("book_id", "source_norm", F.coalesce("name", "term").alias("source_term"), "target_term")
    return c.select(F.lit(None).cast("int").alias("book_id"), "*").unionByName(more)


def accept(candidates: DataFrame, configured: DataFrame) -> DataFrame:
    """Candidates (book_id, source_norm, target_term) with the status that accepting all of them gives:
    ACCEPTED, CONFLICT where the configured term (source_norm, target_term) has another target, or PENDING
    without a target of their own."""
    c = configured.select("source_norm", F.col("target_term").alias("configured_target"))
    out = candidates.join(c, "source_norm", "left")
    own = blank(F.col("target_term"))
    differs = F.coalesce(blank(F.col("configured_target")) != own, F.lit(False))
    return out.select("book_id", "source_norm", "target_term", F.when(own.isNull(), "PENDING").when(differs, "CONFLICT").otherwise("ACCEPTED").alias("status"))


def acceptance_counters(accepted: DataFrame) -> DataFrame:
    s = F.col("status")
    return accepted.groupBy("book_id").agg(F.count_if(s == "ACCEPTED").alias("accepted"), F.count_if(s == "CONFLICT").alias("conflicts"), F.count_if(s == "PENDING").alias("pending"))


def found_in(texts: DataFrame, keys: list[str], glossary: DataFrame) -> DataFrame:
    """Terms (source_term) that occur, whatever their case, in any text of a key, sorted. A few terms are looked for
    in the row, more by automata in one pass a block of terms."""
    t = glossary.select(F.trim("source_term").alias("term")).where("term <> ''").distinct()
    few = t.limit(terms.FEW + 1).collect()  # bounded
    low = texts.select(*keys, F.lower("text").alias("low"))
    if len(few) <= terms.FEW:
        each = F.array_compact(F.array(*[F.when(F.col("low").contains(F.lower(F.lit(r.term))), r.term) for r in few])) if few else F.array().cast("array<string>")
        found = low.select(*keys, F.explode_outer(each).alias("term")).where("term is not null")
    else:
        t = t.select(F.lower("term").alias("low"), "term")
        found = reduce(DataFrame.unionByName, [terms.hits(low, keys, rows) for rows in terms.blocks(t, t.count())])
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("term")).alias("terms"))
