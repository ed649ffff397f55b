"""Long paragraphs cut into parts that give the paragraph again when joined by a space.

A cascade: sentences, clauses, lines, words. A step cuts the text into units and packs them greedily into parts of
at most ``limit`` characters; it is skipped if it has one unit only, if its units joined by a space are not the text, or if a
unit is longer than a part. Words may be packed only if every part but the last is at least half full. Where no
step can cut it, the text stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

# Characters of a part; marks that end a sentence (with what closes it) and a clause.
LIMIT = 1800
SENTENCE_END = r"([.!?…。！？]+[\"'”’»)\]]*)\s"
CLAUSE_END = "([,;:，；：、])"
_CUT = "\x1f"


def _units(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, _CUT), T.norm), lambda u: u != "")


def sentences(text: Column) -> Column:
    return _units(F.regexp_replace(text, SENTENCE_END, f"$1{_CUT}"))


def clauses(text: Column) -> Column:
    return _units(F.regexp_replace(text, CLAUSE_END, f"$1{_CUT}"))


def lines(raw: Column) -> Column:
    return _units(F.regexp_replace(raw, r"\R+", _CUT))


def packed(units: Column, limit: int = LIMIT) -> Column:
    """Units joined by spaces into parts of at most limit characters, or one longer unit."""
    state = lambda parts, part: F.struct(parts.alias("parts"), part.alias("part"))

    def step(a: Column, u: Column) -> Column:
        full = F.length(a["part"]) + 1 + F.length(u) > limit
        return F.when(a["part"] == "", state(a["parts"], u)).when(full, state(F.concat(a["parts"], F.array(a["part"])), u)).otherwise(state(a["parts"], F.concat_ws(" ", a["part"], u)))

    return F.aggregate(units, state(F.array().cast("array<string>"), F.lit("")), step, lambda a: F.when(a["part"] == "", a["parts"]).otherwise(F.concat(a["parts"], F.array(a["part"]))))


def split_long(texts: DataFrame, text: str, raw: str, name: str = "parts", limit: int = LIMIT) -> DataFrame:
    """Adds the parts of ``text`` (in normal form; ``raw`` has its line ends). Each step works on what the steps before
    left whole. Explode them by an outer generator: for others Spark filters by size first, and cuts for that again."""
    whole = F.array(F.col(text))
    longest = lambda xs: F.array_max(F.transform(xs, F.length))
    steps = (sentences(F.col(text)), clauses(F.col(text)), lines(F.col(raw)), F.split(F.col(text), " "))
    out = texts.withColumn(name, F.when(F.length(text) <= limit, whole))
    for k, units in enumerate(steps):
        out = out.withColumn("_units", F.when(F.col(name).isNull(), units))
        fits = (F.size("_units") > 1) & (F.array_join("_units", " ") == F.col(text)) & (longest(F.col("_units")) <= limit)
        out = out.withColumn("_parts", F.when(fits, packed(F.col("_units"), limit)))
        several = F.size("_parts") > 1
        if k == len(steps) - 1:
            several &= F.forall(F.slice("_parts", F.lit(1), F.greatest(F.size("_parts") - 1, F.lit(0))), lambda p: F.length(p) >= limit // 2)
        out = out.withColumn(name, F.coalesce(F.col(name), F.when(several, F.col("_parts")))).drop("_units", "_parts")
    return out.withColumn(name, F.coalesce(F.col(name), whole))
