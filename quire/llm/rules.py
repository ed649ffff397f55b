"""Quality rules with risk-controlled thresholds.

Every document gets counts (``measure``); every rule is a rate made of them, larger for worse text. A
document fails a rule if its rate is over the rule's cutoff in its stratum, and goes if it fails any. A
language is a stratum of its own if its clean holdout is large enough for a policy without any rejection to
be admissible; the labelled languages that aren't make up one pooled stratum. Which ones these are depends
on the size of the holdouts alone, so the pool is tested like any other stratum and the bound holds for it
as a whole (not for each language in it). A language without labels is in no stratum: base rules only. Cutoffs come from labelled documents, cut into a tuning part and a holdout by a hash of the
text's class (the least hash of its 8-word windows), so that copies and most near copies fall on one side.

The tuning part picks each rule's cutoff in each stratum (most true rejections, each false one counting
``COST`` times; the laxer one on a tie) and puts the rules in order of that worth: the first rule alone,
the first two together, and so on are the stratum's policies. What is controlled is the policy as a whole:
a policy is admissible if an exact binomial test on the stratum's clean holdout shows a false rejection
rate of at most ``RISK``: P(Bin(n, RISK) <= rejected) <= CONFIDENCE / ((languages + 1) * rules), the
Clopper-Pearson bound with Bonferroni's correction over all policies of all strata, so that all chosen
ones hold together with probability 1 - CONFIDENCE. The longest admissible policy of a stratum is taken;
without one, only base rules reject there. A trial of the test is a class of texts, rejected if any of its
clean documents is: copies aren't independent. So the rate that is bounded is one of different texts.

One rate is a learned lexicon: words whose neighbours (previous and next word) are mostly those of
toxic documents, learned on at most ``SAMPLE`` labelled documents of each class from the tuning part;
counting distinct neighbours rather than documents keeps copies from making words look toxic. All else
(counts, cutoffs) covers every document and label.

Strata, their counts and policies stay tables, however many languages there are: only the number of
languages reaches the driver.

Base rules hold whatever the labels say: fewer than 20 words, or over 30 % of words in 8-word windows
that the text repeats.

Defined results: null and empty texts have no words and fail the base rule; a null language is a
stratum of its own; a document labelled several times is clean only if all its labels are; labels
without a document or with nulls are no evidence; a null id has no labels; of several rows with one id the
least class counts; without labels only base rules reject; equal rows get equal results; extra columns are
ignored here and kept by ``keep_good``; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.decontam import words
from quire.llm.store import BROADCAST_ROWS, stage
from quire.llm.vec import LOWER, Words, chunks, column, hashes, mix, per_text, release, runs, windows

MIN_WORDS, REPEATED_PERCENT, SPAN = 20, 30, 8
RISK, CONFIDENCE, COST = 0.01, 0.1, 20
HOLDOUT = 60  # percent
SAMPLE = 2500
#: Strata whose policies are broadcast at most, a row each.
STRATA = 10_000
SYMBOLS = b"#*$%&|<>"
#: rate: cutoffs, lax to strict
CUTOFFS = {
    "symbol_rate": (0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01),
    "upper_rate": (0.8, 0.6, 0.4, 0.3, 0.2, 0.1),
    "bang_rate": (0.8, 0.5, 0.3, 0.2, 0.1, 0.05),
    "dup_line_rate": (0.9, 0.7, 0.5, 0.3, 0.2),
    "repeat_rate": (0.25, 0.2, 0.15, 0.1),
    "long_word": (40.0, 25.0, 18.0, 14.0, 12.0),
    "toxic_words": (10.0, 5.0, 3.0, 2.0, 1.0, 0.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_lexicon")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def counts(data: np.ndarray, bounds: np.ndarray, lexicon: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text data[bounds[i]:bounds[i + 1]]; bounds start at 0."""
    n = len(bounds) - 1
    w = Words(data, bounds, lower=False)
    starts_char = (data & 0xC0) != 0x80
    out = {"n_words": w.n, "word_chars": per_text(w.mark & starts_char, bounds), "n_symbols": per_text(_SYMBOL[data], bounds)}
    out["n_upper"] = per_text((data >= 0x41) & (data <= 0x5A), bounds)
    out["n_bang"] = per_text(data == 0x21, bounds)
    s, e = runs(data != 0x0A, bounds)
    in_line = np.concatenate([[0], np.cumsum(w.mark, dtype=np.int64)])
    worded = in_line[e] > in_line[s]
    s, e = s[worded], e[worded]
    text = np.searchsorted(bounds, s, "right") - 1
    key = hashes(data, s, e) ^ mix(text.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(text, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(text[at], minlength=n)
    h, end = windows(w.h, w.first, SPAN)
    place = np.flatnonzero(np.arange(len(h)) + SPAN <= end)
    owner = w.text_of()
    key = h[place] ^ mix(owner[place].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    again = place[order[same[:-1] | same[1:]]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + SPAN, -1)
    out["n_repeat_words"] = per_text(np.cumsum(edge[:-1]) > 0, w.first)
    if len(lexicon):
        low = LOWER[data]
        s, e = runs(_WORD[low], bounds)
        h = hashes(low, s, e)
        hit = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h
        out["n_lexicon"] = per_text(hit, np.searchsorted(s, bounds))
    else:
        out["n_lexicon"] = np.zeros(n, np.int64)
    return out


def measure(docs: DataFrame, lexicon: list[str], *keys: str, text: str = "text") -> DataFrame:
    """The key columns and COUNTS of every document. ``text`` names a column, or a field of the last key,
    which then isn't sent twice."""
    known = np.sort(np.array([_hash(w) for w in lexicon], np.uint64))
    keep = docs.select(*keys).schema
    nested = "." in text
    field = keep[keys[-1]].dataType.names.index(text.split(".")[1]) if nested else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(len(keys)) if field is None else batch.column(len(keys) - 1).field(field))
            for a, b in chunks(offsets):
                found = counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known)
                arrays = [batch.column(i).slice(a, b - a) for i in range(len(keys))] + [pa.array(found[c].astype(np.int64)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *COUNTS])
        release()

    schema = T.StructType([*keep.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return docs.select(*keys, *([] if nested else [F.col(text).cast("string").alias("text")])).mapInArrow(task, schema)


def text_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class): the least hash of the 8-word windows of each text; of fewer words, of all words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(1))
            for a, b in chunks(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                h, end = windows(w.h, w.first, SPAN)
                h = np.where((np.arange(len(h)) + SPAN <= end) | (end - w.first[w.text_of()] < SPAN), h, np.iinfo(np.uint64).max)
                least = np.zeros(b - a, np.uint64)
                full = np.flatnonzero(w.n)
                if len(full):
                    least[full] = np.minimum.reduceat(h, w.first[full])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(least.view(np.int64))], names=["doc_id", "class"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, class bigint")


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def rates() -> dict[str, Column]:
    c = F.col
    per = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    return {
        "symbol_rate": per("n_symbols", "word_chars"),
        "upper_rate": per("n_upper", "word_chars"),
        "bang_rate": per("n_bang", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "long_word": per("word_chars", "n_words"),
        "toxic_words": c("n_lexicon").cast("double"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def evidence(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, bad, toxic, class, holdout) of each labelled document. Only labelled texts are cut into
    windows, where their ids, counted, can be broadcast; else all are, so that no text is shuffled."""
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    per = some.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") < 1).alias("low"), (F.max("toxic") > 0).alias("toxic"))
    per = stage(per, "label-rows")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if per.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(per.select("doc_id")), "doc_id", "left_semi")
    classes = text_classes(texts).groupBy("doc_id").agg(F.min("class").alias("class"))
    held = F.pmod(F.xxhash64(F.lit("holdout"), "class"), F.lit(100)) < HOLDOUT
    return per.join(classes, "doc_id").select("doc_id", (F.col("low") | F.col("toxic")).alias("bad"), "toxic", "class", held.alias("holdout"))


def learn_lexicon(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Words whose distinct neighbourhoods belong to toxic documents, by the lower Wilson bound (three
    standard errors) of their share. At most 2 * sample documents are read for it."""
    tuning = labelled.where(~F.col("holdout") & (~F.col("bad") | F.col("toxic")))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = tuning.where("toxic").orderBy(order).limit(sample).unionAll(tuning.where("not toxic").orderBy(order).limit(sample))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id")  # at most 2 * sample ids
    ws = texts.select("toxic", words(F.col("text")).alias("ws"))
    near = ws.select("toxic", F.explode_outer(F.transform("ws", lambda w, i: F.struct(w.alias("w"), F.xxhash64(F.get("ws", i - 1), F.get("ws", i + 1)).alias("near")))).alias("x"))
    per = near.where("x is not null").select("toxic", "x.w", "x.near").distinct().groupBy("w").agg(F.count_if("toxic").alias("t"), F.count("*").alias("n"))
    z2, p, n = 9.0, F.col("t") / F.col("n"), F.col("n")
    low = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    return sorted(r.w for r in per.where((F.col("t") >= 9) & (low > 0.45)).select("w").collect())  # bounded by the sample


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from its largest term down. From the mean on it is said to be 1: that is
    never under a level that matters, and k terms would be for nothing."""
    if k >= n * p:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):  # below the mean every term is smaller than the one before it
        total += term
        if term < 1e-17 * total:
            break
        term *= i / (n - i + 1) * (1 - p) / p
    return min(1.0, math.exp(log) * total)


def admissible(n: int, rejected: list[int], tests: int, *, risk: float = RISK, confidence: float = CONFIDENCE) -> int:
    """How many policies of a stratum to go along: the longest whose rejections, of n clean trials, pass."""
    for k in range(len(rejected), 0, -1):
        if tail(n, rejected[k - 1], risk) <= confidence / tests:
            return k
    return 0


def enough(tests: int, *, risk: float = RISK, confidence: float = CONFIDENCE) -> int:
    """The least number of trials of which none is rejected that passes the test."""
    return math.ceil(math.log(confidence / tests) / math.log1p(-risk))


CHOICE = [f"{what}_{rule}" for rule in CUTOFFS for what in ("cut", "rank")]


def _choices(tuning: DataFrame, cost: int) -> DataFrame:
    """(own, of, CHOICE, n_policies) of each stratum: the best cutoff of each rule that is worth anything,
    and its rank by that worth; null for other rules."""
    of = rates()
    worth = lambda rule, cut: F.count_if(F.col("bad") & (of[rule] > cut)) - cost * F.count_if(~F.col("bad") & (of[rule] > cut))
    sums = [F.array(*(F.struct(worth(rule, cut).alias("worth"), F.lit(-j).alias("lax"), F.lit(cut).alias("cut")) for j, cut in enumerate(grid))) for rule, grid in CUTOFFS.items()]
    best = tuning.groupBy("own", "of").agg(*(F.array_max(x).alias(rule) for rule, x in zip(CUTOFFS, sums, strict=True)))
    order = [F.when(F.col(f"{rule}.worth") > 0, F.struct((-F.col(f"{rule}.worth")).alias("loss"), F.lit(i).alias("rule"))) for i, rule in enumerate(CUTOFFS)]
    ranked = best.withColumn("order", F.transform(F.array_sort(F.array_compact(F.array(*order))), lambda x: x["rule"]))
    place = [F.nullif(F.array_position("order", F.lit(i)), F.lit(0)).cast("int") - 1 for i in range(len(CUTOFFS))]
    columns = [x for rule, at in zip(CUTOFFS, place, strict=True) for x in (F.when(at.isNotNull(), F.col(f"{rule}.cut")).alias(f"cut_{rule}"), at.alias(f"rank_{rule}"))]
    return ranked.select("own", "of", *columns, F.size("order").alias("n_policies"))


def _fails() -> Column:
    """The rank of the first rule that a row fails by the cutoffs beside it, or null."""
    of = rates()
    return F.least(*(F.when(of[rule] > F.col(f"cut_{rule}"), F.col(f"rank_{rule}")) for rule in CUTOFFS))


def _lengths(trials: DataFrame, tests: int, risk: float, confidence: float) -> DataFrame:
    """(own, of, go): how many policies of each stratum to go along, from its trials' (fails, n_policies)."""
    upto = F.array(*(F.count_if(F.col("fails") <= k) for k in range(len(CUTOFFS))))
    counted = trials.groupBy("own", "of").agg(F.count("*").alias("n"), upto.alias("upto"), F.max("n_policies").alias("n_policies"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            go = [admissible(r["n"], r["upto"][: r["n_policies"]], tests, risk=risk, confidence=confidence) for r in batch.select(["n", "upto", "n_policies"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(go, pa.int32())], names=["own", "of", "go"])

    keys = counted.select("own", "of").schema.fields
    return counted.mapInArrow(task, T.StructType([*keys, T.StructField("go", T.IntegerType())]))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by stratum."""
    renamed = right.withColumnsRenamed({"own": "own_", "of": "of_"})
    return left.join(renamed, (F.col("own") == F.col("own_")) & F.col("of").eqNullSafe(F.col("of_")), how).drop("own_", "of_")


def cutoffs(measured: DataFrame, labelled: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE, cost: int = COST) -> DataFrame:
    """(stratum, CHOICE): the policy of each language that has one."""
    rows = measured.where(~base_failed()).join(labelled, "doc_id").select("lang", "class", "holdout", "bad", *COUNTS)
    rows = stage(rows, "labelled-counts")
    clean = F.col("holdout") & ~F.col("bad")
    per = rows.groupBy("lang", "class").agg(F.max(clean).alias("trial")).groupBy("lang").agg(F.count_if("trial").alias("n"))
    per = stage(per, "languages")
    tests = (per.count() + 1) * len(CUTOFFS)
    own = F.col("n") >= enough(tests, risk=risk, confidence=confidence)
    strata = stage(per.select(F.col("lang").alias("stratum"), own.alias("own"), F.when(own, F.col("lang")).alias("of")), "strata")
    rows = rows.join(strata, F.col("lang").eqNullSafe(F.col("stratum"))).drop("lang", "stratum")
    tried = stage(_choices(rows.where("not holdout"), cost), "tried")
    held = _beside(rows.where(clean), tried)
    trials = held.select("own", "of", "class", _fails().alias("fails"), "n_policies").groupBy("own", "of", "class").agg(F.min("fails").alias("fails"), F.max("n_policies").alias("n_policies"))
    chosen = _beside(tried, _lengths(trials, tests, risk, confidence)).where("go > 0")
    left = [F.when(F.col(f"rank_{c.split('_', 1)[1]}") < F.col("go"), F.col(c)).alias(c) for c in CHOICE]
    return stage(_beside(strata, chosen.select("own", "of", *left)).select("stratum", *CHOICE), "policies")


def judge(measured: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds base_failed and kept: whether neither the base rules nor the stratum's policy rejects."""
    policies = F.broadcast(policies) if policies.count() <= STRATA else policies
    out = measured.join(policies, F.col("lang").eqNullSafe(F.col("stratum")), "left")
    return out.select(*measured.columns, base_failed().alias("base_failed"), (~base_failed() & _fails().isNull()).alias("kept"))


def apply_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, text_key, COUNTS, base_failed and kept of every document."""
    labelled = stage(evidence(labels, docs), "labels")
    lexicon = learn_lexicon(docs, labelled)
    keyed = docs.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("text_key"), "text")
    measured = stage(measure(keyed, lexicon, "doc_id", "lang", "text_key"), "counts")
    return judge(measured, cutoffs(measured, labelled, **options))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. Counts are made where the text is read,
    so that nothing but the labelled counts is shuffled."""
    labelled = stage(evidence(labels, docs), "labels")
    lexicon = learn_lexicon(docs, labelled)
    names = docs.columns
    rows = docs.withColumn("text", F.col("text").cast("string"))
    measured = stage(measure(rows.select("doc_id", "lang", F.struct("*").alias("row")), lexicon, "doc_id", "lang", "row", text="row.text"), "counted")
    chosen = cutoffs(measured.drop("row"), labelled, **options)
    return judge(measured, chosen).where("kept").select([F.col("row").getField(c).alias(c) for c in names])
