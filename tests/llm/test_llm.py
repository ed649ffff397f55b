"""The llm operators against plain versions, over awkward rows, empty tables and the smallest tables."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute  # noqa: E402
from quire.llm import boost, bwt, decontam, lines, lm, mainpages, mix, neardup, pages, pii, queries, repeats, rules, sketch, tokens
from quire.llm import dom as D

SF = "/root/testdata/sf0.001"
WORDS = "the of and stone river cloud lamp green seven under öl naïve 中文 x9 ***".split()
random.seed(5)


def prose(n):
    return " ".join(random.choice(WORDS) + (str(random.randint(0, 40)) if random.random() < 0.7 else "") for _ in range(n))


LONG, BASE, PASSAGE = prose(6000), prose(120), prose(30)
ITEMS = [(1, PASSAGE), (2, "seven green Lamp"), (3, None), (4, ""), (5, PASSAGE), (None, prose(15)), (6, "river")]
DOCS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.replace("the", "tha", 1), "en", None), (4, None, None, None), (5, "", "de", "b"), (6, " \n\t ", "de", "b"),
    (7, LONG, "fr", "c"), (8, prose(40) + "\n" + PASSAGE + "\n" + prose(40), "en", "a"), (9, "one", "en", "b"), (10, "one", "en", "b"), (11, "Two words", None, "b"),
    (12, LONG[:3000] + " other end", "fr", "c"), (13, "a" * 700, "en", "a"), (14, "line one\nline one\n\nline two\n" * 30, "en", "z"), (15, prose(300), "es", "a"),
    (16, "seven green lamp! " + prose(12), "es", "a"), (17, "\x0b\x1f odd\x00bytes é́  nbsp", "es", "z"), (1, BASE, "en", "a"),
]
DOCS += [(100 + i, prose(60), random.choice(["en", "de"]), random.choice("abc")) for i in range(40)]
UNIQUE = list({d[0]: d for d in DOCS}.values())
EXTRA = "text_key long, row string, h_id long, bucket int, block long, n long"


def frame(spark, rows, parts=3):
    """With columns whose names the operators use themselves."""
    rows = [(*r, 7, "x", None, 1, 2, 3) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + EXTRA).repartition(parts)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(math.isclose(p, q, rel_tol=1e-9) if isinstance(p, float) else p == q for p, q in zip(x, y, strict=True)), (x, y)


def texts(rows):
    return [(r[0], r[1]) for r in rows]


def test_lm(spark):
    rows = [*DOCS, (None, "no id here", "en", "a"), (None, None, "en", "a"), (3, BASE, "en", "a")]
    for block in (2000, lm.BLOCK):
        got = rows_of(lm.score(frame(spark, rows), block=block), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        close(got, sorted(brute.lm(texts(rows)), key=repr))


def test_lm_without_training_texts(spark):
    rows = [(d, "a b a", "en", "a") for d in range(2000) if brute.lm([(d, "")])[0][1]][:3]
    got = rows_of(lm.score(frame(spark, rows)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    close(got, sorted(brute.lm(texts(rows)), key=repr))
    assert math.isclose(got[0][5], 4 * lm.unknown(0, 0), abs_tol=1e-9)


def test_lm_sums_to_one():
    """Over all words and the unknown one, in states of every order, seen and not."""
    rng = np.random.default_rng(2)
    p1 = rng.dirichlet(np.ones(50))
    for h1, h2 in ((40, 12), (40, 0), (0, 0)):
        c2, c3 = rng.multinomial(h1, p1).astype(float), rng.multinomial(h2, p1).astype(float)
        full = lambda x: np.full(50, float(x))
        assert math.isclose((10 ** lm.traverse([c2, c3], [full(h1), full(h2)], p1)).sum(), 1, rel_tol=1e-9)


def test_sorted_keys_of_every_size():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    for some in (keys, keys[:1], keys[:0], np.array([0, 2**64 - 1], np.uint64)):
        assert (lm._unzip_sorted(lm._zip_sorted(some)) == some).all()


def test_decontamination(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for block in (1_000_000, 8):
        d = decontam.decontaminate(frame(spark, UNIQUE), items, block=block)
        d = d.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), (F.col("n_hit") > 0).alias("c"))
        assert rows_of(d, *d.columns) == sorted(brute.decontaminate(texts(UNIQUE), ITEMS), key=repr)
    kept = decontam.drop_contaminated(frame(spark, DOCS), items)
    bad = {r[0] for r in brute.decontaminate(texts(UNIQUE), ITEMS) if r[-1]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d[0] for d in DOCS if d[0] not in bad)
    assert kept.columns == frame(spark, DOCS).columns


def test_decontamination_of_common_phrases(spark):
    """A phrase of many items, in other words each time, meets only the windows that are there; items of
    every short length, and equal items, are found in one pass."""
    rng = random.Random(3)
    word = lambda n: " ".join(f"w{rng.randint(0, 9)}" for _ in range(n))
    phrase = "which of the following is"
    items = [(i, f"{word(6)} {phrase} {word(6)}") for i in range(60)] + [(100 + n, word(n)) for n in range(1, 10)]
    items += [(200, items[0][1]), (None, items[1][1]), (201, None), (202, " . ")]
    docs = [(i, f"{word(3)} {phrase} {word(4)} {items[i % 60][1].upper() if i % 3 else ''} {word(3)}") for i in range(40)]
    want = sorted(brute.decontaminate(docs, items), key=repr)
    d = decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    d = d.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), (F.col("n_hit") > 0).alias("c"))
    assert rows_of(d, *d.columns) == want
    assert any(r[3] > 2 for r in want)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near(spark, k, percent):
    rows = UNIQUE + [(900 + i, BASE + f" tail{i}", "en", "a") for i in range(30)] + [(None, "one", "en", "a")]
    found = neardup.near_duplicates(frame(spark, rows), k=k, percent=percent)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(brute.near(texts(rows), k, percent), key=repr)
    kept = neardup.drop_near_duplicates(frame(spark, DOCS), k=k, percent=percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute.near(texts(UNIQUE), k, percent)})


def test_sketch():
    a, b = np.arange(1, 2001, dtype=np.uint64), np.arange(201, 2201, dtype=np.uint64)
    spread = lambda x: np.sort(sketch.mix(x))
    regs = sketch.registers(np.concatenate([spread(a), spread(b)]), np.array([0, 2000, 4000]))
    union = sketch.registers(spread(np.arange(1, 2201, dtype=np.uint64)), np.array([0, 2200]))
    assert (sketch.merge(regs[:1], regs[1:]) == union).all()
    assert abs((regs[0] == regs[1]).mean() - 1800 / 2200) < 0.15


def test_tokens(spark):
    rows = [*DOCS, (None, "no id", "en", "a"), (None, None, "en", "a"), (500, prose(30) * 40, "en", "a")]
    for shards_a_file in (64, 2):
        path = tokens.write(frame(spark, rows), queries.tokenizer_path(), shard_ids=500, shards_a_file=shards_a_file)
        got = rows_of(tokens.read(spark, path), "doc_id", "start", "n_tokens", "ids_crc32")
        assert got == sorted(brute.token_ids(texts(rows), queries.tokenizer_path()), key=repr)
    ids = {r.start: r.ids for r in tokens.read(spark, path, with_ids=True).collect()}
    assert all(len(x) == n and ids[s] for (_, s, n, _), x in zip(got, (ids[g[1]] for g in got), strict=True))


def test_random_access_by_ranges(spark):
    path = tokens.write(frame(spark, UNIQUE), queries.tokenizer_path(), shard_ids=3000, shards_a_file=3)
    places = tokens.index(spark, path)
    whole = {r.doc_id: r.ids for r in tokens.read(spark, path, with_ids=True).collect()}
    rng = random.Random(4)
    for r in places.collect():
        assert r.n_tokens == len(whole[r.doc_id])
        for i in {0, r.n_tokens - 1, rng.randrange(r.n_tokens)}:
            one = tokens.Ranges(r.file)
            assert one.token(r.shard_at, r.inside + i) == whole[r.doc_id][i]
            assert one.n_read < 28 + 4 * 8 + 4 * (1 + 64 + 4)
    assert tokens.token(places, 7, 77) == whole[7][77]
    with pytest.raises(IndexError):
        tokens.token(places, 9, 99)


def test_codes():
    ids = np.array([0, 1, 255, 256, 70000, 2**32 - 1, 5] * 300, np.uint32)
    raw = tokens.pack(ids, [3, None], [2000, 100])
    shard = tokens.Shard(memoryview(b"xx" + raw + b"\n"), 2)
    assert (shard.ids() == ids).all() and shard.doc_ids == [3, None] and shard.lengths.tolist() == [2000, 100] and shard.end == 2 + len(raw)


def test_long_text_and_other_tokenizers(monkeypatch):
    """Parts of a long text, and tokenizers whose tokens hold white space, which get whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CHUNK", 300)
    text = prose(400) + " " + "x" * 700 + "\n" + prose(50)
    for name, by_piece in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        enc = tokens._Encoder(public_tokenizers.path(name))
        assert enc.by_piece == by_piece
        want = Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode_long(memoryview(text.encode())), "<u4").tolist() == want


def test_repeats(spark):
    for block in (4_000_000, 9000):
        got = rows_of(repeats.remove_repeats(frame(spark, UNIQUE), keep=False, block=block), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == sorted(brute.repeats(sorted(texts(UNIQUE))), key=repr)


def test_windows_of_hot_anchors_have_two_hashes(monkeypatch):
    """With a first hash that takes all windows for one: the other tells them apart, and equal ones not."""
    monkeypatch.setattr(repeats, "BYTE", np.ones(256, np.uint64))
    one, two = np.random.default_rng(7).integers(0, 256, (2, 400), np.uint8)
    data, bounds = np.concatenate([one, two, one]), np.array([0, 400, 800, 1200])
    *_, anchor, _ = repeats.segments(data, bounds, np.zeros(0, np.uint64))
    text, start, run, anchor, content = repeats.segments(data, bounds, np.unique(anchor))
    assert (run == 1).all() and len(start) == 3 * 301 and len(set(content)) == 1 and len(set(anchor)) == 2 * 301
    assert (anchor[text == 0] == anchor[text == 2]).all()


def test_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 0)
    monkeypatch.setattr(repeats, "REPORT", 1)
    got = rows_of(repeats.remove_repeats(frame(spark, UNIQUE), keep=False), "doc_id", "n_removed")
    assert got == sorted(((r[0], r[2]) for r in brute.repeats(sorted(texts(UNIQUE)))), key=repr)


def test_hot_anchors_are_joined_with_blocks(spark, monkeypatch):
    """More hot anchors than the tasks carry: the same rows, in one block and in many."""
    monkeypatch.setattr(repeats, "HOT", 0)
    monkeypatch.setattr(repeats, "REPORT", 1)
    monkeypatch.setattr(repeats, "CARRIED", 0)
    want = sorted(((r[0], r[2]) for r in brute.repeats(sorted(texts(UNIQUE)))), key=repr)
    for block in (4_000_000, 9000):
        assert rows_of(repeats.remove_repeats(frame(spark, UNIQUE), keep=False, block=block), "doc_id", "n_removed") == want


def test_contents_of_an_anchor():
    """Contents whose hashes differ in the lower half only are not equal."""
    contents = np.array([5 << 32 | 1, 5 << 32 | 2, 5 << 32 | 1], np.uint64)
    places = {"doc_ids": (np.arange(3), "<i8"), "text_keys": (np.arange(3), "<i8"), "starts": (np.zeros(3), "<i4"), "runs": (np.ones(3), "u1")}
    row = {"bucket": 0, "block": 0, "anchors": np.ones(3, np.uint64).tobytes(), "contents": contents.tobytes(), **{k: repeats._zip(x.astype(t)) for k, (x, t) in places.items()}}
    told = next(repeats._tell(iter([repeats._rows([row], repeats._schema(repeats.ASK))]))).to_pylist()[0]
    assert repeats._unzip(told["answers"], repeats.U1).tolist() == [2, 2, 1]


def test_hot_anchors_of_all_blocks(spark, monkeypatch):
    """A phrase that each block has once, in other surroundings, is hot; the bytes of its contents are sent whole."""
    found, ask = [], repeats._ask
    monkeypatch.setattr(repeats, "HOT", 20)
    monkeypatch.setattr(repeats, "_ask", lambda n, hot: found.append(len(hot)) or ask(n, hot))
    rng = random.Random(2)
    other = lambda: "".join(rng.choice("abcdefghij ") for _ in range(150))
    rows = [(i, f"{other()} this phrase of some sixty bytes stands in every one of the texts {other()}") for i in range(80)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False, block=300)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeats(rows), key=repr)
    assert found and found[0] > 0


def test_transforms_merge():
    base = bytes(random.choice(b"ab") for _ in range(300))
    some = [np.frombuffer(base[a : a + 160], np.uint8) for a in (0, 7, 7, 90, 140)] + [np.zeros(0, np.uint8)]
    group = bwt.common(some, 50, shard_bytes=100)
    seen, at = {}, 0
    for t in some:
        for i in range(len(t)):
            s = bytes(t[i : i + 50])
            assert (group[at + i] == -1) if len(s) < 50 else seen.setdefault(s, group[at + i]) == group[at + i]
        at += len(t)
    assert len(set(seen.values())) == len(seen)


def test_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, 1), (777, 1, 0)], "doc_id long, quality long, toxic long")
    got = rules.apply_rules(frame(spark, UNIQUE), labels)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(brute.quality(texts(UNIQUE)), key=repr)
    assert got.where("base_failed and kept").isEmpty()
    kept = rules.keep_good(frame(spark, DOCS), labels)
    assert kept.columns == frame(spark, DOCS).columns


def test_quality_of_short_tables(spark):
    """Chunks whose texts hold fewer words than a window, each alone in its partition."""
    rows = [(i, " ".join(WORDS[:i]), "en") for i in range(10)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = sorted(brute.quality(texts(rows)), key=repr)
    assert rows_of(rules.apply_rules(docs, labels), *cols) == want
    assert rows_of(rules.apply_rules(docs.where("doc_id = 4").coalesce(1), labels), *cols) == [want[4]]


def test_binomial():
    assert math.isclose(rules.tail(10, 0, 0.1), 0.9**10) and rules.tail(5, 5, 0.3) == 1.0 and rules.tail(0, 0, 0.1) == 1.0
    for n, k, p in ((300, 2, 0.05), (4000, 20, 0.01), (900, 0, 0.01)):
        exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(rules.tail(n, k, p), exact, rel_tol=1e-9)
    assert rules.tail(10**9, 9_990_000, 0.01) < 1


def test_mix(spark):
    got = mix.schedule(frame(spark, UNIQUE)).collect()
    size = {r.doc_id: r["size"] for r in got}
    assert size == {d: len(brute.WORD.findall(t or "")) for d, t in texts(UNIQUE)}
    total, per = sum(size.values()), {}
    for r in got:
        assert r.n_taken <= 3
        x = per.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.n_taken * r["size"]
    assert math.isclose(sum(x[1] for x in per.values()), total) and all(x[1] <= 3 * x[2] + 1e-6 for x in per.values())
    longest = max(size.values())
    assert all(abs(taken - target) <= 2 * longest for taken, target, _ in per.values())
    assert mix.mix(frame(spark, DOCS)).count() == sum(r.n_taken for r in mix.schedule(frame(spark, DOCS)).collect())


def test_lines(spark):
    a = "\n".join(prose(8) for _ in range(10))
    b = "\n".join([prose(8), *a.split("\n")[2:7], prose(8)])
    rows = [(1, a, "en", "a"), (2, b, "en", "a"), (3, None, "en", "a"), (4, "", "en", "a")] + [(10 + i, prose(9), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and got[1].n_deleted == 0 and got[2].n_deleted == 5
    assert got[2].text == "\n".join([b.split("\n")[0], b.split("\n")[-1]]) and got[3].text == "" and got[3].n_lines == 0


def line_rows(spark, rows):
    return rows_of(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_deleted", "text")


def test_lines_of_blocks(spark):
    """Crossed, doubled, cut and edited copies of several texts: as if all pairs were aligned."""
    rows = [(1, "own 1\ny\nx\nown 2"), (2, "x\ny"), (3, "x\ny"), (4, "x\ny\nnew"), (5, "r\ns"), (6, "r\nt\nr\nq"), (7, "r\nt\nr\nu"), (8, "z\n\nw"), (9, "z\n\nw")]
    blocks = [[f"b{b} line {i}" for i in range(4 + b)] for b in range(6)]
    rng = random.Random(3)
    for i in range(10, 40):
        some = [line for b in sorted(rng.sample(range(6), 3)) for line in blocks[b]]
        rows.append((i, "\n".join(line if rng.random() < 0.95 else f"edit {i}" for line in some)))
    got = line_rows(spark, rows)
    assert got == sorted(brute.line_dedup(rows, lines.patience), key=repr)
    assert [r[2] for r in got if r[0] in (3, 4)] == [2, 2]


def test_lines_of_moved_blocks(spark):
    """Blocks in any order: nothing but what all pairs delete, and most of that."""
    rng = random.Random(3)
    rows = [(i, "\n".join(f"b{b} line {x}" for b in rng.sample(range(6), 3) for x in range(4 + b))) for i in range(60)]
    got, want = line_rows(spark, rows), sorted(brute.line_dedup(rows, lines.patience), key=repr)
    assert all(not Counter(w[3].split("\n")) - Counter([*g[3].split("\n"), ""]) for g, w in zip(got, want, strict=True))
    assert sum(r[2] for r in got) >= 0.9 * sum(r[2] for r in want)
    few = rows[:16]  # no line has more than RARE holders: nothing is left
    assert line_rows(spark, few) == sorted(brute.line_dedup(few, lines.patience), key=repr)


def test_lines_of_all_documents(spark):
    """Lines and texts that most documents hold, and null ids, which come last."""
    rows = [(i, "same\ntext") for i in range(3)] + [(None, "same\ntext"), (None, "head\nsame"), (7, "same\nmore"), (None, None), (8, "head\nown")]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    got = line_rows(spark, rows)
    assert got == sorted(brute.line_dedup(ordered, lines.patience), key=repr)
    assert [r[2] for r in got if r[0] in (0, 1, 2)] == [0, 2, 2]
    assert [r[2] for r in line_rows(spark, rows[:3])] == [0, 2, 2]


def test_pii(spark):
    t = ["Mail Bob.7@mail3.example.com, bob.7@MAIL3.example.com; +1 (743) 555-3824 or +1-743-555-3824; 4111 1111 1111 1111.", 'Mrs. Anna Smith, Mr. Smith at 10.2.33.254; token = "64be24439e3e49cf46b2d7c90f3602a3d0b907ff"', None, "", "plain 12 words", "x bob.7@mail3.example.com"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(df, key="k").collect()}
    again = {r.doc_id: r for r in pii.replace_entities(df, key="k").collect()}
    assert got == again and got[4].text == t[4] and got[2].text == "" and got[0].kinds == "card,email,email,phone,phone"
    for old in ("Bob.7", "743", "4111", "Smith", "Anna", "10.2.33.254", "64be"):
        assert all(old not in r.text for r in got.values())
    mail = got[5].text.split()[1]
    assert got[0].text.lower().count(mail) == 2  # the same entity, three times
    digits = lambda s: "".join(c for c in s if c.isdigit())
    a, b = got[0].text.split("; ")[1].split(" or ")
    assert digits(a) == digits(b) and len(digits(a)) == 11
    many = spark.createDataFrame([(i, f"at {i % 10}.{i // 10}.1.1 now") for i in range(100)], "doc_id long, text string")
    found = [r.text.split()[1] for r in pii.replace_entities(many, key="k").collect()]
    assert len(set(found)) == 100 and not set(found) & {f"{i % 10}.{i // 10}.1.1" for i in range(100)}


def test_pages(spark):
    held_out = 0
    for seed in range(20_000, 20_060):
        source, ranges = mainpages.labelled(seed)
        page = D.Page(source)
        want = "\n\n".join(D.texts(page, pages.node_labels(page, source, ranges)[0] > 0))
        held_out += pages.main_texts([source], pages.model())[0] == want
    assert held_out >= 48
    html = "<html><body><nav><a href=/>Menu</a></nav><article><h1>A &amp; B</h1><p>Some   text\n here, and more of it.<p>Second one, which is longer than that.</article><footer>Foot</footer>"
    rows = [(1, "u", html), (2, None, None), (3, "v", ""), (4, "w", "<p"), (5, "u", html)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B\n\nSome text here, and more of it.\n\nSecond one, which is longer than that." == got[5].text
    assert got[2].text == "" == got[3].text and got[1].n_chars == len(got[1].text)


def test_names_and_bare_mentions(spark):
    t = ["Mrs. Anna Smith came. Anna Smith's tea; then SMITH, smithy and Smithson.", "Mr. J. Miller and Mr. BAKER met Mr. John Paul Cooper.", "Prof. Dr. Eva Stone; Stone", "Card 3782 822463 10005.", "Smith stays: no name is known here."]
    got = {r.doc_id: r for r in pii.replace_entities(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string"), key="k").collect()}
    for i, old in enumerate((r"Anna|Smith\b|SMITH", r"J\.|Miller|BAKER|John|Paul|Cooper", "Eva|Stone", "822463")):
        assert not re.search(old, got[i].text), got[i].text
    words = re.findall(r"\w+", got[0].text)
    assert words[1:3] == words[4:6] and words[9] == words[2].upper() and got[0].text.endswith(", smithy and Smithson.") and "'s tea; then " in got[0].text
    assert got[0].n_entities == 4 and got[0].kinds == "name,name,name,name" and got[3].kinds == "card" and got[4].text == t[4]


def test_no_text_is_dropped_outside_the_classifier():
    def all_text(source):
        page = D.Page(source)
        return D.texts(page, np.ones(len(page.tag), bool))

    assert all_text('<p>One<svg viewBox="0 0 1 1" /> two<svg/> three</p><p>Four<svg><path d="M0"/>no</svg> five') == ["One two three", "Four five"]
    assert all_text("<p>One<svg width=1/>no</svg> two</p>") == ["One two"]
    for attribute in ('title="a hidden gem"', 'class="prose hidden md:block"', 'data-x="display: none"', "hidden", 'aria-hidden="true"', "style='display:none'"):
        assert all_text(f"<div {attribute}><p>Text.</p></div><p>End.") == ["Text.", "End."], attribute
    assert [D._hidden(x) for x in (" hidden", ' style="a:b;display: none"', " aria-hidden=true", ' title="a hidden gem"', ' class="x hidden y"', ' aria-hidden="false"', ' data-x="display:none"')] == [True] * 3 + [False] * 4


def test_boosted():
    x = np.random.default_rng(1).normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = boost.Boosted(columns=1.0).fit(x[:1500], y[:1500], np.ones(1500))
    assert ((m.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    import corpus_pipeline

    for name, q in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
        assert q(spark, str(tmp_path)).count() == 0, name


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns, name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert 0 < out.count() <= 3 * n and os.path.exists(queries.tokenizer_path())


def test_pieces_are_forgotten_and_found_again(monkeypatch):
    """With room for a few pieces only."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["", " ", "\n\n"] + [" ".join(f"w{rng.randint(0, 300)} é{rng.randint(0, 9)}" + rng.choice(["", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    for kept in (10, 100, 10_000):
        monkeypatch.setattr(tokens, "KEPT", kept)
        enc, got = tokens._Encoder(path), []
        for a in range(0, len(texts), 20):
            raw = [t.encode() for t in texts[a : a + 20]]
            got += enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])))
        assert [x.tolist() for x in got] == want
        assert len(enc.known.h) <= kept
