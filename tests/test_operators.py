"""Golden cases of the engine's operators, and every query against its SQL."""

from __future__ import annotations

import io
import math
import os
import random
import re
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import glossary, quality, sequence, terms
from quire.plans import catalogue
from quire.sources import epub, library
from quire.streaming import dispatch

SF = "/root/testdata/sf0.001"


def clean(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(clean(x) for x in v)
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    r = con.execute(catalogue.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(clean(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


def test_tokens(spark):
    rows = [("Run GPU_X9 at 2.4GHz, then read font.table.v3 again.", "再读一次"), ("Call `drawPage()` with $m=kv$ in \\sqrt{x}{y} twice.", "调用两次。")]
    df = spark.createDataFrame(rows, "s string, t string")
    got = [set(r.m) for r in df.select(T.missing_tokens(F.col("s"), F.col("t")).alias("m")).collect()]
    assert {"GPU_X9", "2.4GHz", "font.table.v3"} <= got[0]
    assert {"`drawPage()`", "$m=kv$", "\\sqrt{x}"} <= got[1]


def test_terms_of_any_length(spark):
    """A run of 200,000 capitalised words is one match, too long for a term; the terms around it stay, as the SQL's pattern has them."""
    rng = random.Random(3)
    words = "Of of the The IN in AB ABc Abc Abcd abc A Ab ofX Ab1 X_Y Été Zoë Rome, (Oslo) NASA's on- On ÀB Paris  the\tand".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += ["near Lake Como " + "x " + "Alpha OMEGA " * 100_000 + "x then Lake Garda", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.terms for r in df.select("id", T.terms(F.col("t")).alias("terms")).collect()}
    useful = lambda t: 4 <= len(t) <= 80 and t not in T.STOP_TERMS and t.split(" ")[0] not in T.STOP_TERMS
    for i, t in enumerate(texts):
        found = [re.sub(r"\s+", " ", x) for x in re.findall(T.TERM, t or "", re.ASCII)]
        assert (got[i] or []) == [x for x in found if useful(x)]
    assert got[400] == ["Lake Como", "Lake Garda"]


@pytest.mark.parametrize("name", ["candidate_upsert", "glossary_acceptance", "glossary_conflicts", "glossary_merge_fill", "glossary_merge_overwrite", "merge_counters"])
def test_terms_are_found_once(spark, name):
    """What asks for the books' terms twice or more reads a table of them, not the texts."""
    import __spark_entry__

    files = __spark_entry__.queries()[name](spark, SF).inputFiles()
    assert any("/terms/" in p for p in files) and not any("documents.parquet" in p for p in files)


@pytest.mark.parametrize("name", ["effective_glossary", "glossary_acceptance", "glossary_conflicts", "glossary_merge_fill", "glossary_merge_overwrite"])
def test_terms_of_a_long_line(spark, tmp_path, name):
    """Books with a line of 200,000 capitalised words: the query ends, with the rows of its SQL."""
    import __spark_entry__

    rng = random.Random(5)
    words = "Of of the The IN in Rome Oslo Lake Como Paris Garda NASA Alps stone x, river. There Ther Ing AND".split(" ")
    texts = [rng.choice(["\n", " \n\n"]).join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(6)) for _ in range(200)]
    long = "Lake Como stone " + "Alpha OMEGA " * 100_000 + "stone Lake Garda"
    docs = [(i, long if i % 50 == 3 else t, f"src{i % 11}") for i, t in enumerate(texts)] + [(200, None, "src3"), (201, "", "src4"), (202, "no term here", "src12")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    r = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(clean(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert len(want) > 2 and got == want


def test_dialogue_by_ends(spark):
    """A closing quotation mark counts at the very end only, as in the SQL, not before a line separator."""
    texts = ["“Yes", "yes”", "yes”\u2028", ' "x', "- x", "-x", "HE SAID no", "İ said", "Said x", "saida", "", None]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.is_dialogue(F.col("t")).alias("d")).collect()]
    assert got == [True, True, False, True, True, False, True, False, True, False, False, None]


def test_many_terms_by_automata(spark, monkeypatch):
    """As if each term were looked for in each segment; letters that lower-casing makes longer too."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("stone river Lamp İzmir of an x7 green hillside".split()) for _ in range(rng.randint(1, 12))) for _ in range(80)]
    words = [(t, f"T{t}") for t in ("stone", "Riv", "river", "of", "x", "en hill", "İzmir", "izmir", "missing", "STONE")] + [("of", "other"), (" of ", "Tof"), (None, "x"), ("y", " ")]
    more = [(f"absent{i}", "y") for i in range(250)]
    rows = [(i, t, rng.choice(["Tstone Tof", "", "TRiv other", None]), "TRANSLATED" if i % 7 else "FAILED") for i, t in enumerate(texts)] + [(99, None, "x", "TRANSLATED"), (98, "", "", "TRANSLATED")]
    s = spark.createDataFrame(rows, "segment_id long, source_text string, translated_text string, status string")
    g = lambda ws: spark.createDataFrame(ws, "source_term string, target_term string")
    few = sorted(quality.glossary_misses(s, g(words)).collect())
    assert len(few) > 40
    assert sorted(quality.glossary_misses(s, g(words + more)).collect()) == few
    monkeypatch.setattr(terms, "BLOCK", 40)
    assert sorted(quality.glossary_misses(s, g(words + more)).collect()) == few
    assert quality.glossary_misses(s, g([])).isEmpty()


def test_a_hundred_thousand_terms(spark):
    """One pass finds them all: word i stands in text i, and its target in every third translation."""
    n = 100_000
    g = spark.range(n).select(F.concat(F.lit("Term"), F.lpad(F.hex("id"), 6, "0"), F.lit(";")).alias("source_term"), F.concat(F.lit("t"), "id").alias("target_term"))
    s = spark.range(3000).select(F.col("id").alias("segment_id"), F.concat(F.lit("the tERM"), F.lower(F.lpad(F.hex(F.col("id") * 33), 6, "0")), F.lit("; and no more term")).alias("source_text"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id") * 33)).otherwise("-").alias("translated_text"), F.lit("TRANSLATED").alias("status"))
    assert sorted((r.segment_id, r.n_missed) for r in quality.glossary_misses(s, g).collect()) == [(i, 1) for i in range(3000) if i % 3]


def test_terms_of_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "A stone in İzmir"), (1, "Of rivers"), (2, "x"), (3, ""), (4, None), (5, "Stones of x7"), (5, "Stones of x7")], "k long, text string")
    found = spark.createDataFrame([("Stone",), (" of ",), ("X",), ("river",), ("i",), ("",), (None,), ("absent",), ("stone",)], "source_term string")
    few = {r.k: r.terms for r in glossary.found_in(texts, ["k"], found).collect()}
    assert {k: set(v) for k, v in few.items()} == {1: {"Stone", "stone", "i", "of", "river"}, 2: {"X"}, 5: {"Stone", "stone", "X", "of"}}
    monkeypatch.setattr(terms, "FEW", 0)
    assert {r.k: r.terms for r in glossary.found_in(texts, ["k"], found).collect()} == few
    assert glossary.found_in(texts, ["k"], found.limit(0)).isEmpty()


def _books_of(spark, path):
    """{book: texts} of the library, and that its tables agree."""
    out = {}
    for r in library.table(spark, path, "segments").collect():
        out.setdefault(r.book_id, []).append(r.source_text)
    counts = {r.book_id: r.segments for r in library.table(spark, path, "books").collect()}
    assert counts == {b: len(x) for b, x in out.items()}
    assert library.table(spark, path, "chapters").agg(F.sum("segments")).first()[0] == sum(counts.values())
    return {b: sorted(x) for b, x in out.items()}


def test_library(spark, tmp_path, monkeypatch):
    """Stopped, repeated, concurrent and replacing runs give each book once and whole."""
    path, kind = str(tmp_path / "library"), "segment_id long, chapter_id long, book_id int, segment_order long, source_text string"
    make = lambda book, text, n=3: [(100 * book + i, book, book, i, f"{text} {i}") for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, kind).repartition(2)
    with pytest.raises(FileNotFoundError):
        library.table(spark, path, "books")
    one = frame(make(1, "a") + make(2, "b") + [(9, 9, None, 1, "no book")])
    with monkeypatch.context() as m:  # a run that is stopped before it is published
        m.setattr(library, "_files", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            library.ingest(one, path)
    library.ingest(one, path)
    library.ingest(one.orderBy("segment_id"), path)  # again, in another order
    want = {1: ["a 0", "a 1", "a 2"], 2: ["b 0", "b 1", "b 2"]}
    assert _books_of(spark, path) == want
    same = [library.write(frame(make(3, "c")), path) for _ in range(2)]  # two runs at a time, both published
    assert same[0][1] == same[1][1] and same[0][0] != same[1][0]
    for batch, key in same:
        fs, p = library._files(spark, f"{path}/published/{2:012d}.{key}.{batch}")
        assert fs.createNewFile(p)
    library.ingest(frame(make(2, "new", 1)), path)
    library.ingest(frame([]), path)
    want |= {3: ["c 0", "c 1", "c 2"], 2: ["new 0"]}
    assert _books_of(spark, path) == want
    assert library.vacuum(spark, path) == 2 and library.vacuum(spark, path) == 0
    assert _books_of(spark, path) == want


def book(body: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>')
        z.writestr("OEBPS/content.opf", '<package><metadata><title>Demo Book</title></metadata><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>')
        z.writestr("OEBPS/c.xhtml", f"<html><body>{body}</body></html>")
    return out.getvalue()


def test_books(spark):
    rows = epub.book_rows("b", book("<h1>The Harbour</h1><p>The boats came in.</p><p>2048</p><p>www.example.org</p><p>...</p><p>1.</p><blockquote><p>q</p></blockquote><p class='poetry'>v</p><pre>w</pre>"))
    assert [(r[7], r[8]) for r in rows] == [("The Harbour", "TITLE"), ("The boats came in.", "PARAGRAPH"), ("q", "QUOTE"), ("v", "POETRY"), ("w", "POETRY")]
    assert rows[0][1] == "Demo Book"
    assert epub.book_rows("b", b"not epub")[0][-1] == "not an archive"
    with pytest.raises(epub.Rejected):
        epub.entries(book("<p>x</p>"), max_entries=1)
    with pytest.raises(epub.Rejected):
        epub.entries(book("<p>x</p>"), max_entry_bytes=4)
    text = "A sentence of some length stands here. " * 80
    parts = epub.split_long(text.strip())
    assert len(parts) > 1 and " ".join(parts) == text.strip()
    books = spark.createDataFrame([("b", bytearray(book("<h1>One</h1><p>Two</p>")))], "path string, content binary")
    s = epub.read_books(books).withColumn("translated_text", F.concat(F.lit("Z "), "source_text"))
    out = epub.export_books(books, s).first()
    assert [r[7] for r in epub.book_rows("b", bytes(out.content))] == ["Z One", "Z Two"]
    both = epub.export_books(books, s, bilingual=True).first()
    assert [r[7] for r in epub.book_rows("b", bytes(both.content))] == ["One", "Z One", "Two", "Z Two"]


def test_batches_of_books(spark):
    """A task returns the rows of small books together, and those of a large one in parts: no batch grows with the books."""
    many = [((f"b{i}", b"x" * 10), 10) for i in range(10_000)]
    sizes = [b.num_rows for b in epub.gathered(iter(many), epub.ARCHIVES)]
    assert sum(sizes) == 10_000 and max(sizes) == epub.BATCH and len(sizes) == 3
    large = [b.nbytes for b in epub.gathered((((f"b{i}", b"x" * 1_000_000), 1_000_000) for i in range(20)), epub.ARCHIVES)]
    assert len(large) == 4 and max(large) < (epub.BATCH_MB + 2) << 20
    assert list(epub.gathered(iter([]), epub.ARCHIVES)) == []
    books = spark.createDataFrame([(f"b{i}", bytearray(book(f"<h1>Title {i}</h1><p>12</p><p>Été</p><p>a1!</p><p>ñ!</p>" if i % 5 else "<p>"))) for i in range(300)], "path string, content binary").coalesce(1)
    rows = epub.read_books(books)
    assert rows.where("error is null").count() == 240 * 4 and rows.where("error is not null").count() == 60
    whole = rows.where("error is null").withColumn("translated_text", F.col("source_text"))
    assert epub.export_books(books, whole).count() == 240


def test_parts_are_dealt_by_size(spark, monkeypatch):
    """More rows get more tasks, and all parts of a segment are in one of them."""
    monkeypatch.setattr(sequence, "TASK", 10)
    df = sequence.dealt(spark.range(1000).selectExpr("id div 5 as k", "id"), "k")
    at = df.select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert df.rdd.getNumPartitions() == 100 and len(at) == len({r.k for r in at}) == 200


def test_reports_score_once(spark):
    """Reports read scored segments three times, from a table that is written once."""
    s = catalogue._scored(spark, SF)
    for report in (quality.report_markdown(s), quality.report_json(s), catalogue.QUERIES["review_counters"](spark, SF)):
        assert {p.split("/")[-2] for p in report.inputFiles()} <= {"scored", "candidates"}


def test_dispatch():
    from datetime import datetime, timedelta

    t = datetime(2024, 1, 1)

    def run(outcomes, n=2):
        state, actions = ("PENDING", 0, None, 0), []
        for k, o in enumerate(outcomes):
            state, a = dispatch.step(state, t + timedelta(minutes=k), o, n)
            actions.append(a)
        return state[0], actions

    assert run(["success", "success"]) == ("COMPLETED", ["COMPLETE", "ACK"])
    assert run(["failure"] * 3) == ("SUPERSEDED", ["RETRY", "RETRY", "SPLIT"])
    assert run(["failure"] * 3, 1) == ("FAILED", ["RETRY", "RETRY", "FAIL"])
    assert run(["crash", "success"]) == ("RUNNING", ["LEASE", "ACK"])


def test_stream(spark, tmp_path):
    from quire.plans import relations as R

    e = R.table(spark, SF, "events").select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("requested_at"), F.when(F.col("value") % 2 < 1, "failure").otherwise("success").alias("outcome"), F.lit(2).alias("n_segments"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = dispatch.dispatch(stream).writeStream.format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    key = lambda df: sorted((r.chunk_id, str(r.requested_at), r.action) for r in df.collect())
    assert key(spark.table("acts")) == key(dispatch.dispatch(e))
