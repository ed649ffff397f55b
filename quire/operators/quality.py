"""Quality rules over translated segments, their warnings, scores and the review choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import terms
from quire.operators.sequence import number
from quire.sources.scratch import stage

# Points off by rule.
PENALTIES = {"source_repeated_in_translation": 35, "english_residue": 20, "suspicious_length_ratio": 20, "preserved_token_missing": 20, "placeholder_mismatch": 30}
GLOSSARY_PENALTY = 25
REVIEWABLE = [*PENALTIES, "glossary_term_missing"]


def _wanted(glossary: DataFrame) -> DataFrame:
    g = glossary.where((F.trim("source_term") != "") & (F.trim(F.coalesce("target_term", F.lit(""))) != ""))
    return g.select(F.trim("source_term").alias("term"), F.trim("target_term").alias("target")).distinct()


def with_misses(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds n_missed: how many terms stand in the source, whatever the case, while the translation lacks
    their target. A few terms are counted in the row, more by automata in one pass a block of terms."""
    g = _wanted(glossary)
    few = g.limit(terms.FEW + 1).collect()  # bounded
    told = (F.col("status") == "TRANSLATED") & F.col("translated_text").isNotNull()
    if len(few) <= terms.FEW:
        missed = [(F.col("_low").contains(r.term.lower()) if r.term.isascii() else F.col("_low").contains(F.lower(F.lit(r.term)))) & ~F.col("translated_text").contains(r.target) for r in few]
        n = sum((m.cast("int") for m in missed), F.lit(0))
        once = segments.select("*", F.explode(F.array(F.lower("source_text"))).alias("_low"))  # a generator: filters on the count don't fold the case again
        return once.select(*segments.columns, F.when(told, F.coalesce(n, F.lit(0))).otherwise(0).alias("n_missed"))
    s = segments.where(told & F.col("source_text").isNotNull()).select("segment_id", F.lower("source_text").alias("low"), "translated_text")
    g = g.select(F.lower("term").alias("low"), "term", "target")
    found = reduce(DataFrame.unionByName, [terms.misses(s, rows) for rows in terms.blocks(g, g.count())])
    counts = found.groupBy("segment_id").agg(F.sum("n").cast("int").alias("n_missed"))
    return segments.join(counts, "segment_id", "left").withColumn("n_missed", F.coalesce("n_missed", F.lit(0)))


def glossary_misses(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """(segment_id, n_missed) of the segments that miss any."""
    return with_misses(segments, glossary).where("n_missed > 0").select("segment_id", F.col("n_missed").cast("long").alias("n_missed"))


def reasons(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds reasons (in order of the rules, the glossary's once for each missed term) and score. They are
    made once, behind a generator: filters and counts on them don't repeat the rules."""
    s = with_misses(segments, glossary)
    source, shown = T.norm(F.col("source_text")), T.norm(T.strip_placeholders(F.coalesce("translated_text", F.lit(""))))
    s = s.withColumns({"_s": source, "_t": shown})
    tests = {
        "source_repeated_in_translation": T.source_repeated(F.col("_s"), F.col("_t")),
        "english_residue": T.english_residue(F.col("_t")),
        "suspicious_length_ratio": T.suspicious_ratio(F.col("_s"), F.col("_t")),
        "preserved_token_missing": F.size(T.missing_tokens(F.col("source_text"), F.col("translated_text"))) > 0,
    }
    if "placeholders" in segments.columns:
        tests["placeholder_mismatch"] = (F.size("placeholders") > 0) & T.placeholder_fault(F.col("placeholders"), F.col("translated_text")).isNotNull()
    rules = F.concat(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])), F.array_repeat(F.lit("glossary_term_missing"), F.col("n_missed")))
    failed, missing = F.col("status") == "FAILED", (F.col("status") != "TRANSLATED") | (F.col("_t") == "")
    found = F.when(failed, F.array(F.lit("segment_failed"))).when(missing, F.array(F.lit("missing_translation"))).otherwise(rules)
    s = s.select(*segments.columns, (failed | missing).alias("_none"), F.explode(F.array(F.struct(found.alias("reasons")))).alias("_made"))
    s = s.select(*segments.columns, "_none", F.col("_made.reasons").alias("reasons"))
    off = F.aggregate("reasons", F.lit(0), lambda a, r: a + points(r))
    return s.select(*segments.columns, "reasons", F.when(F.col("_none"), 0).otherwise(F.greatest(F.lit(0), 100 - off)).alias("score"))


def points(reason: Column) -> Column:
    out = F.when(reason == "glossary_term_missing", GLOSSARY_PENALTY)
    for name, p in PENALTIES.items():
        out = out.when(reason == name, p)
    return out.otherwise(0)


def book_scores(scored: DataFrame) -> DataFrame:
    return scored.groupBy("book_id").agg(F.floor(F.avg("score") + 0.5).cast("long").alias("quality_score"), F.count("*").alias("n_segments"))


def warnings(scored: DataFrame) -> DataFrame:
    """One row a reason, with its place in the rules."""
    return scored.select("book_id", "segment_id", T.preview(T.norm(F.col("source_text"))).alias("preview"), F.posexplode_outer("reasons").alias("position", "code")).where("code is not null")


def review_candidates(scored: DataFrame, *, min_score: int = 80, codes: list[str] | None = None) -> DataFrame:
    """Translated segments below the score or with a chosen reason; n_warnings counts chosen ones."""
    chosen = F.filter("reasons", lambda r: r.isin(*(REVIEWABLE if codes is None else codes or [""])))
    c = scored.where((F.col("status") == "TRANSLATED") & (F.trim(F.coalesce("translated_text", F.lit(""))) != ""))
    c = c.withColumn("n_warnings", F.size(chosen).cast("long"))
    return c.where(((F.col("score") < 100) | (F.col("n_warnings") > 0)) & ((F.col("score") < min_score) | (F.col("n_warnings") > 0)))


def review_top(candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k worst of each book: score, then most warnings, then id."""
    w = Window.partitionBy("book_id").orderBy("score", F.desc("n_warnings"), "segment_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, min(k, 100)))


def review_counters(candidates: DataFrame, updated: DataFrame, k: int = 20) -> DataFrame:
    """Of each book: candidates, those selected for review, and those of them that were updated."""
    top = review_top(candidates, k).select("segment_id", F.lit(True).alias("chosen"))
    done = updated.select("segment_id", F.lit(True).alias("done"))
    c = candidates.join(top, "segment_id", "left").join(done, "segment_id", "left")
    return c.groupBy("book_id").agg(F.count("*").alias("candidates"), F.count("chosen").alias("selected"), F.count(F.when(F.col("chosen"), F.col("done"))).alias("updated"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def with_headings(notes: DataFrame) -> DataFrame:
    """Adds whether a note's chapter has another title than that of the note before it in the book, in order of chapter, segment and
    when it was made; the note before is found in parts of a book."""
    order = [F.col(x) for x in ("chapter_order", "segment_order", "created_at", "note_id")]
    n = number(notes, ["book_id"], *order, name="i", before={"title_before": F.col("chapter_title")})
    return n.withColumn("new_heading", (F.col("i") == 1) | ~F.col("chapter_title").eqNullSafe(F.col("title_before"))).drop("title_before")


def notes_markdown(notes: DataFrame) -> DataFrame:
    """The Markdown of each note by its place in the book, with the book's head before the first and a heading where the
    chapter's title changes."""
    c = F.col
    head = F.when(c("i") == 1, _text("# My Notes - ", c("book_title"), "\n\n")).otherwise("")
    heading = F.when(c("new_heading"), _text("## ", c("chapter_title"), "\n\n")).otherwise("")
    shown = F.when(c("translated_text").isNull(), "").otherwise(_text("> ", T.strip_placeholders(c("translated_text")), "\n"))
    note = _text(head, heading, "**Segment ", c("segment_order"), "** (", F.to_date("created_at"), ")\n> ", c("source_text"), "\n", shown, "\n**Note:** ", c("note_content"), "\n\n")
    return with_headings(notes).select("book_id", "i", "note_id", note.alias("markdown"))


#: What a warning says, by its code; those without an entry say what they found.
MESSAGES = {
    "segment_failed": "This segment could not be translated.",
    "missing_translation": "This segment has no translation.",
    "source_repeated_in_translation": "The translation holds the whole source text.",
    "english_residue": "Much of the translation is still English.",
    "suspicious_length_ratio": "The translation is much shorter or longer than the source.",
    "preserved_token_missing": "Tokens to be kept are not in the translation.",
    "placeholder_mismatch": "Inline placeholders differ from those of the source.",
    "glossary_term_missing": "A term of the glossary is not translated as it says.",
}
#: Codes that are errors; the others are warnings.
ERRORS = ("segment_failed", "missing_translation")


def message(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        out = F.when(code == name, text).otherwise(out)
    return out


def severity(code: Column) -> Column:
    return F.when(code.isin(*ERRORS), "error").otherwise("warning")


def _statistics(scored: DataFrame) -> DataFrame:
    n = F.sum(F.size("reasons")).cast("long")
    terms_missed = F.sum(F.size(F.filter("reasons", lambda r: r == "glossary_term_missing"))).cast("long")
    return scored.groupBy("book_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "TRANSLATED").alias("translated"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.floor(F.avg("score") + 0.5).alias("score"), n.alias("n_warnings"), terms_missed.alias("n_terms"),
    )


def report_markdown(scored: DataFrame) -> DataFrame:
    """Lines by book, section (0 head, 1 warnings, 2 scores), segment and position. A section's heading stands before its
    first segment (id -1)."""
    scored = stage(scored.select("book_id", "segment_id", "status", "reasons", "score"), "scored")  # read three times
    c, zero, before = F.col, F.lit(0), F.lit(-1).cast("long")
    head = _text(
        "# Consistency Report\n\n- Book ID: ", c("book_id"), "\n- Total segments: ", c("total"), "\n- Translated segments: ", c("translated"), "\n- Failed segments: ", c("failed"),
        "\n- Quality score: ", c("score"), "\n- Warnings: ", c("n_warnings"), "\n- Term warnings: ", c("n_terms"), "\n",
    )
    lines = F.array(head, F.when(c("n_warnings") > 0, "\n## Warnings\n\n").otherwise("\nNo warnings.\n"), F.lit("\n## Segment Scores\n\n"))
    heads = _statistics(scored).select("book_id", F.posexplode_outer(lines).alias("section", "markdown")).select("book_id", "section", before.alias("segment_id"), zero.alias("position"), "markdown")
    why = F.when(F.size("reasons") > 0, _text(" (", F.array_join("reasons", ", "), ")")).otherwise("")
    scores = scored.select("book_id", F.lit(2).alias("section"), "segment_id", zero.alias("position"), _text("- Segment ", c("segment_id"), ": ", c("score"), "/100", why, "\n").alias("markdown"))
    told = scored.select("book_id", F.lit(1).alias("section"), "segment_id", F.posexplode_outer("reasons").alias("position", "code")).where("code is not null")
    told = told.select("book_id", "section", "segment_id", "position", _text("- [", severity(c("code")), "] ", c("code"), " segment ", c("segment_id"), ": ", message(c("code")), "\n").alias("markdown"))
    return heads.unionByName(told).unionByName(scores)


def report_json(scored: DataFrame) -> DataFrame:
    """A book's report in parts, so that none grows with the book: its figures as one JSON (``part`` head), a JSON each segment's score
    (score) and each warning (warning), by segment and position."""
    told = F.when(F.size("reasons") > 0, T.preview(T.norm(F.col("source_text")))).alias("source_text")
    scored = stage(scored.select("book_id", "segment_id", "segment_order", "status", told, "reasons", "score"), "scored")  # read three times
    c, zero, before = F.col, F.lit(0), F.lit(-1).cast("long")
    head = F.to_json(F.struct("book_id", "total", "translated", "failed", "score", "n_warnings", "n_terms"))
    heads = _statistics(scored).select("book_id", F.lit("head").alias("part"), before.alias("segment_id"), zero.alias("position"), head.alias("json"))
    score = F.to_json(F.struct("segment_id", "segment_order", "score", "reasons"))
    scores = scored.select("book_id", F.lit("score").alias("part"), "segment_id", zero.alias("position"), score.alias("json"))
    told = scored.select("book_id", "segment_id", "segment_order", "source_text", F.posexplode_outer("reasons").alias("position", "code")).where("code is not null")
    warning = F.to_json(F.struct("code", severity(c("code")).alias("severity"), "segment_id", "segment_order", message(c("code")).alias("message"), "source_text"))
    return heads.unionByName(scores).unionByName(told.select("book_id", F.lit("warning").alias("part"), "segment_id", "position", warning.alias("json")))
