"""The risk that the quality rules promise, and labels that do choose cutoffs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import rules

WORDS = [f"w{i}" for i in range(3000)]


def test_false_rejections_of_a_policy_are_bounded():
    """Over many made-up holdouts: the chosen policy's true rate is over RISK in at most CONFIDENCE of them."""
    rng = np.random.default_rng(3)
    strata, trials, over, chosen = 4, 1500, 0, 0
    rates = np.array([[0.002, 0.006, 0.009, 0.0105, 0.012, 0.02, 0.03], [0.0101] * 7, [0.0001, 0.0002, 0.011, 0.011, 0.011, 0.011, 0.011], [0.008, 0.008, 0.0099, 0.013, 0.013, 0.013, 0.013]])
    for _ in range(trials):
        wrong = False
        for s in range(strata):
            n = int(rng.integers(400, 9000))
            first = rng.choice(8, size=n, p=[*np.diff([0, *rates[s]]), 1 - rates[s][-1]])  # the rule that rejects a trial first, if any
            k = rules.admissible(n, [int((first <= j).sum()) for j in range(7)], strata * 7)
            chosen += k
            wrong |= k > 0 and rates[s][k - 1] > rules.RISK
        over += wrong
    assert over / trials <= rules.CONFIDENCE and chosen > trials


def corpus(seed=1, clean=1500, junk=300):
    rng = random.Random(seed)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, prose(rng.randint(25, 60)) + "." * (i % 2), "en", 1, 0) for i in range(clean)]
    rows += [(clean + i, prose(30).replace(" ", "#$%*<> "), "en", 0, 0) for i in range(junk)]
    rows += [(5000 + i, prose(30), "de", 1, 0) for i in range(50)] + [(6000 + i, prose(30).replace(" ", "#$%*<> "), "de", 0, 0) for i in range(50)]
    return rows


def test_labels_choose_cutoffs(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows if r[0] % 2 or r[0] >= 5000 or r[0] < 1200], "doc_id long, quality long, toxic long")
    got = {r.doc_id: r for r in rules.apply_rules(docs, labels).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    good = [r[0] for r in rows if r[2] == "en" and r[3] == 1]
    assert sum(not got[d].kept for d in good) <= rules.RISK * len(good)
    assert all(not got[r[0]].kept for r in rows if r[2] == "en" and r[3] == 0)
    assert all(got[r[0]].kept for r in rows if r[2] == "de")  # too few labels to show anything
    kept = rules.keep_good(docs.withColumn("class", F.lit(1)).withColumn("fails", F.lit(2)), labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept) and kept.columns == ["doc_id", "text", "lang", "class", "fails"]


def test_small_languages_are_pooled(spark):
    """Three languages too small for a test each pass one together; a language without labels is in no pool."""
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    junk = lambda: prose(30).replace(" ", "#$%*<> ")
    langs = ["de", None, "fr"]
    rows = [(i, prose(30), langs[i % 3], 1) for i in range(1500)] + [(2000 + i, junk(), langs[i % 3], 0) for i in range(300)]
    bare = [(3000 + i, junk(), "xx", 0) for i in range(20)]
    docs = spark.createDataFrame([r[:3] for r in rows + bare], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows], "doc_id long, quality long, toxic long")
    tests = 4 * len(rules.CUTOFFS)
    assert 0.99 ** rules.enough(tests) <= rules.CONFIDENCE / tests < 0.99 ** (rules.enough(tests) - 1)
    assert 500 * rules.HOLDOUT / 100 < rules.enough(tests)
    got = {r.doc_id: r.kept for r in rules.apply_rules(docs, labels).collect()}
    assert not any(got[r[0]] for r in rows if r[3] == 0) and all(got[r[0]] for r in bare)
    assert sum(not got[r[0]] for r in rows if r[3] == 1) <= rules.RISK * 1500


def test_policies_against_a_plain_version(spark):
    """Cutoffs, ranks and lengths of every stratum, for more languages than labels for them."""
    rng = random.Random(9)
    langs = [None, "a", "b", *(f"l{i}" for i in range(40))]
    rows = []
    for i in range(6000):
        lang = rng.choice(langs[:3]) if rng.random() < 0.9 else rng.choice(langs)
        bad = rng.random() < 0.2
        rows.append((i, lang, 100, 500, int(rng.expovariate(0.02 if bad else 1)), 0, 0, 10, int(rng.expovariate(0.01 if bad else 0.3)), 0, rng.choice([0, 0, 1]) if bad else 0, bad, i % 5000, rng.random() < 0.6))
    names = ["doc_id", "lang", *rules.COUNTS, "bad", "class", "holdout"]
    kinds = ["long", "string", *["long"] * len(rules.COUNTS), "boolean", "long", "boolean"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    got = {r.stratum: {c: r[c] for c in rules.CHOICE if r[c] is not None} for r in rules.cutoffs(frame.drop("bad", "class", "holdout"), frame.select("doc_id", "bad", "class", "holdout")).collect()}

    rows = [dict(zip(names, r, strict=True)) for r in rows]
    per = lambda a, b: lambda r: r[a] / max(r[b], 1)
    rate = {"symbol_rate": per("n_symbols", "word_chars"), "upper_rate": per("n_upper", "word_chars"), "bang_rate": per("n_bang", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "long_word": per("word_chars", "n_words"), "toxic_words": lambda r: r["n_lexicon"]}
    tests = (len({r["lang"] for r in rows}) + 1) * 7
    trials = {s: len({r["class"] for r in rows if r["lang"] == s and r["holdout"] and not r["bad"]}) for s in langs}
    group = {s: ("own", s) if trials[s] >= rules.enough(tests) else "pool" for s in langs}
    assert {"pool"} < set(group.values())
    want = {}
    for g in set(group.values()):
        mine = [r for r in rows if group[r["lang"]] == g]
        order = []
        for i, (rule, grid) in enumerate(rules.CUTOFFS.items()):
            worth = [sum((1 if r["bad"] else -rules.COST) for r in mine if not r["holdout"] and rate[rule](r) > cut) for cut in grid]
            if max(worth) > 0:
                order.append((-max(worth), i, rule, grid[worth.index(max(worth))]))
        order.sort()
        first = {}
        for r in mine:
            if r["holdout"] and not r["bad"]:
                first[r["class"]] = min(first.get(r["class"], 99), next((k for k, o in enumerate(order) if rate[o[2]](r) > o[3]), 99))
        k = rules.admissible(len(first), [sum(f <= k for f in first.values()) for k in range(len(order))], tests)
        if k:
            for s in langs:
                if group[s] == g:
                    want[s] = {f"{what}_{o[2]}": x for rank, o in enumerate(order[:k]) for what, x in (("cut", o[3]), ("rank", rank))}
    assert got == want and want


def test_copies_are_one_trial(spark):
    """A thousand copies of a clean text show no more than one."""
    rows = [(i, " ".join(WORDS[:40]), "en", 1, 0) for i in range(1000)] + [(2000 + i, " ".join(WORDS[i : i + 30]) + " #$%*|<>" * 9, "en", 0, 0) for i in range(200)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], r[4]) for r in rows], "doc_id long, quality long, toxic long")
    classes = {r.doc_id: r["class"] for r in rules.text_classes(docs).collect()}
    assert len({classes[i] for i in range(1000)}) == 1
    assert all(r.kept for r in rules.apply_rules(docs, labels).collect())


def test_null_ids_repeated_rows_and_short_texts(spark):
    text = " ".join(WORDS[:25])
    docs = spark.createDataFrame([(None, text, None), (None, text, None), (1, text, "en"), (1, text, "en"), (1, "x", "en"), (2, None, "en"), (3, "", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, 0, None), (3, None, None)], "doc_id long, quality long, toxic long")
    got = [(r.doc_id, r.n_words, r.kept) for r in rules.apply_rules(docs, labels).collect()]
    assert sorted(got, key=repr) == sorted([(None, 25, True), (None, 25, True), (1, 25, True), (1, 25, True), (1, 1, False), (2, 0, False), (3, 0, False)], key=repr)
