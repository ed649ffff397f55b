"""Blocks, templates and their checks on pages written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import markup

PAGES = {
    "<h2>Tides</h2><p>The sea <em>rose</em> and <a href='x>y'>fell</a>.</p>": [("h2", "TITLE", "Tides", None), ("p", "PARAGRAPH", "The sea rose and fell.", "The sea [id0]rose[id1] and [id2]fell[id3].")],
    "<ul><li><p>Salt</p> and more</li><li>Sand<li>Silt</ul><p>End": [
        ("li", "LIST_ITEM", "Salt and more", None), ("p", "PARAGRAPH", "Salt", None), ("li", "LIST_ITEM", "Sand", None), ("li", "LIST_ITEM", "Silt", None), ("p", "PARAGRAPH", "End", None),
    ],
    "<ol><li>One<ol><li>Inner <b>bold</b></li></ol></li><li>Two</li></ol>": [("li", "LIST_ITEM", "OneInner bold", None), ("li", "LIST_ITEM", "Inner bold", "Inner [id0]bold[id1]"), ("li", "LIST_ITEM", "Two", None)],
    "<blockquote class=x><p>Quoted</p><div><p>So is this</p></div></blockquote><p>Not this</p></blockquote><p>Nor this</p>": [("p", "QUOTE", "Quoted", None), ("p", "QUOTE", "So is this", None), ("p", "PARAGRAPH", "Not this", None), ("p", "PARAGRAPH", "Nor this", None)],
    "<p class='A first-verse'>v</p><p CLASS=\"pull quote\">q</p><pre>w\n  x</pre><figcaption>A boat</figcaption><p class='reverse'>r</p>": [
        ("p", "POETRY", "v", None), ("p", "QUOTE", "q", None), ("pre", "POETRY", "w x", None), ("figcaption", "IMAGE_CAPTION", "A boat", None), ("p", "PARAGRAPH", "r", None),
    ],
    "<p>2048</p><p>½</p><p>www.example.org</p><p>&#8212;</p><p> <b> </b></p><p>Kept &amp;lt; &#x41;&#66; &lt;b&gt;</p>": [("p", "PARAGRAPH", "Kept &lt; AB <b>", None)],
    "<p>A <b><i>deep</i> nest</b></p><p>cross <b>a <i>b</b> c</i></p><p>open <b>ended</p><p>with <br>break <i>x</i></p><p>with <img src='a'/> image</p>": [
        ("p", "PARAGRAPH", "A deep nest", "A [id0][id2]deep[id3] nest[id1]"), ("p", "PARAGRAPH", "cross a b c", None), ("p", "PARAGRAPH", "open ended", None), ("p", "PARAGRAPH", "with break x", None), ("p", "PARAGRAPH", "with image", None),
    ],
    "<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>a < b <!-- </p> --> c</p></p></li>": [("p", "PARAGRAPH", "a < b c", None)],
    "no blocks at all": [],
    "": [],
}


def test_blocks(spark):
    rows = [(i, html, "x", 1) for i, html in enumerate(PAGES)] + [(-1, None, "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, html string, tok string, i int").repartition(3)
    found = markup.blocks(df).orderBy("page_id", "element").collect()
    for i, (html, want) in enumerate(PAGES.items()):
        assert [(r.tag, r.block_type, r.block_text, r.template) for r in found if r.page_id == i] == want, html
    assert {r.page_id for r in found} <= set(range(len(PAGES)))
    deep = next(r for r in found if r.template and r.template.startswith("A [id0]"))
    assert [(p.token, p.kind) for p in deep.placeholders] == [("[id0]", "OPEN"), ("[id2]", "OPEN"), ("[id3]", "CLOSE"), ("[id1]", "CLOSE")]
    assert markup.blocks(df.limit(0)).isEmpty()


def test_many_attributes_and_long_pages(spark):
    """Neither a tag of very many attributes nor a long page is too deep for the pattern."""
    tag = "<p " + " ".join(f'a{i}="v > {i}"' for i in range(400)) + ">"
    html = tag + "text</p>" + "<p>word <b>bold</b></p>" * 3000 + "<p>" + "long " * 100_000 + "</p>"
    found = markup.blocks(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert found.count() == 3002 and found.where("template = 'word [id0]bold[id1]'").count() == 3000


def test_faults(spark):
    expected = "array(named_struct('token', '[id0]', 'kind', 'OPEN'), named_struct('token', '[id2]', 'kind', 'OPEN'), named_struct('token', '[id3]', 'kind', 'CLOSE'), named_struct('token', '[id1]', 'kind', 'CLOSE'))"
    cases = [
        ("[id0]灯[id2]塔[id3][id1]", None, None),
        ("[id0]灯[id3][id2]塔[id1]", "placeholders in another order", "placeholders cross at [id3]"),
        ("[id0]灯[id2]塔[id3]", "placeholders lost: [id1]", "never closed: [id0]"),
        ("[id1]", "placeholders lost: [id0], [id2], [id3]", "placeholders cross at [id1]"),
        ("[id0][id0][id2][id3][id1]", "placeholders twice: [id0]", "never closed: [id0]"),
        ("[id0][id7][id7][id1]", "placeholders too many: [id7]", "unknown placeholder [id7]"),
        ("  ", "no placeholder is left", None),
        (None, "no placeholder is left", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").withColumn("e", F.expr(expected))
    tokens = F.transform("e", lambda p: p["token"])
    got = {r.i: (r.a, r.b, r.s) for r in df.select("i", T.placeholder_fault(tokens, F.col("t")).alias("a"), T.nesting_fault(F.col("e"), F.col("t")).alias("b"), T.display(F.col("t"), tokens).alias("s")).collect()}
    for i, (text, fault, nesting) in enumerate(cases):
        assert got[i][:2] == (fault, nesting), text
    assert got[0][2] == "灯塔" and got[5][2] == "[id7][id7]" and got[7][2] is None


def test_tokens_are_cut_once(spark):
    """Blocks read a table of tokens, not the pages again and again."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    assert {p.split("/")[-2] for p in markup.blocks(pages).inputFiles()} == {"tokens"}
