"""Blocks and inline placeholders of marked-up pages, in column functions.

A page is cut into tokens (tags, comments, raw elements, text) by one pattern that matches every character.
Nesting comes from running sums over the tokens: of one tag name, starts add one and ends take one away, and never
below none; a start and the next end at its level belong together. A block is an interval of tokens, so a block
inside another is one interval inside another, and both give rows.

What is not closed: a paragraph or heading ends at the next tag of block level, as it holds none; another block
without an end tag does too; an end tag without a start counts for nothing; a quotation that is never
closed lasts to the end of the page. An attribute may hold any quoted character.

Defined results: a null or empty page has no blocks; page ids are unique; blocks whose text is not
translatable are left out; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources.scratch import stage

# Blocks that are taken, tags of block level, tags without an end, inline tags that become placeholders.
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
BLOCKS = [*HEADINGS, "p", "li", "pre", "figcaption"]
LEVEL = (
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
INLINE = "a abbr b cite code em i kbd mark q s small span strong sub sup u var".split()

ATTRIBUTES = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
TOKEN = rf"(?s)<!--.*?-->|(?i:<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>)|</?[a-zA-Z]{ATTRIBUTES}>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<"
NAME = r"^</?(?:[a-zA-Z0-9_-]+:)?([a-zA-Z][a-zA-Z0-9_-]*)"
CLASS = r"""(?i)\sclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Words of a class that tell verse and quotations, alone or with a hyphen.
VERSE, QUOTE = ("poem", "poetry", "verse", "stanza"), ("quote", "blockquote")


def decoded(x: Column) -> Column:
    """Character references as characters: numbers, the five of XML, the no-break space, the ampersand last."""
    seen = F.array_distinct(F.regexp_extract_all(x, F.lit(r"&#(\d{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))
    real = lambda c: ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c < 0x110000))
    char = lambda n: F.when(real(_conv(n)), F.decode(F.unhex(F.lpad(F.hex(_conv(n)), 8, "0")), "UTF-32")).otherwise("�")
    x = F.when(x.contains("&#"), F.aggregate(seen, x, lambda a, n: F.replace(a, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))).otherwise(x)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        x = F.replace(x, F.lit(f"&{name};"), F.lit(c))
    return x


def _conv(n: Column) -> Column:
    """The number of a reference, decimal or with x before it."""
    hexed = F.conv(F.substring(n, 2, 6), 16, 10)
    return F.when(n.rlike("^[xX]"), hexed).otherwise(n).cast("long")


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, i, tok, kind, name``: kind is open, close, void (no end), text or none."""
    t = pages.select("page_id", F.posexplode_outer(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("i", "tok")).where("tok is not null")
    name = F.lower(F.regexp_extract("tok", NAME, 1))
    tag = F.col("name") != ""
    raw = F.col("name").isin("script", "style")
    kind = F.when(raw, "none").when(tag & F.col("tok").startswith("</"), "close").when(tag & (F.col("name").isin(VOID) | F.col("tok").rlike(r"/\s*>$")), "void").when(tag, "open")
    kind = kind.when(F.col("tok").rlike("^<[!?]"), "none").otherwise("text")
    return t.withColumn("name", name).select("page_id", "i", "tok", kind.alias("kind"), "name")


def _level(over: Window) -> Column:
    """The level of a start (from 1) or an end, of the running total; ends without a start have none (0)."""
    lowest = F.least(F.lit(0), F.min("_total").over(over.rowsBetween(Window.unboundedPreceding, -1)))
    return F.col("_total") + F.when(F.col("kind") == "close", 1).otherwise(0) - F.coalesce(lowest, F.lit(0))


def intervals(t: DataFrame) -> DataFrame:
    """Of each start tag of a block: ``page_id, i, j, name, tok, quoted``: its content is tokens i + 1 to j - 1;
    whether it is in a quotation."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    page = Window.partitionBy("page_id")
    ahead, back = page.orderBy("i"), page.orderBy(F.desc("i"))
    level = (F.col("name").isin(LEVEL)) & F.col("kind").isin("open", "close", "void")
    t = t.withColumn("next", F.last(F.when(level, F.col("i")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("end", F.max("i").over(page) + 1)
    quote = F.when(F.col("name") == "blockquote", step).otherwise(0)
    t = t.withColumn("_quotes", F.sum(quote).over(ahead))
    t = t.withColumn("quoted", F.col("_quotes") > F.least(F.lit(0), F.min("_quotes").over(ahead)))
    t = t.where(F.col("name").isin(BLOCKS) & F.col("kind").isin("open", "close"))
    named = Window.partitionBy("page_id", "name").orderBy("i")
    t = t.withColumn("_total", F.sum(step).over(named))
    t = t.withColumn("level", _level(named))
    same = Window.partitionBy("page_id", "name", "level").orderBy("i")
    closed = F.when(F.lead("kind").over(same) == "close", F.lead("i").over(same))
    leaf = F.col("name").isin(*HEADINGS, "p")
    j = F.when(leaf, F.coalesce("next", "end")).otherwise(F.coalesce("closed", "next", "end"))
    return t.withColumn("closed", closed).where("kind = 'open'").select("page_id", "i", j.alias("j"), "name", "tok", "quoted")


def kind_of(name: Column, classes: Column, quoted: Column) -> Column:
    has = lambda words: classes.rlike("|".join(rf"(?:^|\s){w}(?:\s|$)|-{w}|{w}-" for w in words))
    return (
        F.when(name.isin(HEADINGS), "TITLE").when(name == "li", "LIST_ITEM").when((name == "pre") | has(VERSE), "POETRY")
        .when(quoted | has(QUOTE), "QUOTE").when(name == "figcaption", "IMAGE_CAPTION").when(name == "p", "PARAGRAPH").otherwise("OTHER")
    )


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks with text to translate: ``page_id, element`` (its token), ``tag, block_type, block_text, raw_text,
    template, placeholders``. Inline tags are numbered depth first as placeholders: a tag takes two numbers where it
    starts. A block without inline tags, with other elements inside, or whose tags don't nest, has no template."""
    t = stage(tokens(pages), "tokens")  # read three times
    found = intervals(t)
    inner = found.where("j > i + 1").select("page_id", F.col("i").alias("block"), F.explode(F.sequence(F.col("i") + 1, F.col("j") - 1)).alias("i"))
    x = inner.join(t, ["page_id", "i"])
    inline = F.col("name").isin(INLINE) & F.col("kind").isin("open", "close")
    foreign = (F.col("name") != "") & F.col("kind").isin("open", "void") & ~inline
    x = x.select("page_id", "block", "i", "name", F.when(inline, F.col("kind")).alias("kind"), foreign.alias("foreign"), F.when(F.col("kind") == "text", decoded(F.col("tok"))).alias("piece"))
    x = x.where("kind is not null or foreign or piece is not null")
    over = Window.partitionBy("page_id", "block").orderBy("i")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    x = x.withColumn("depth", F.sum(step).over(over)).withColumn("order", F.sum((F.col("kind") == "open").cast("int")).over(over) - 1)
    x = x.withColumn("level", F.when(F.col("kind").isNotNull(), F.col("depth") + (F.col("kind") == "close").cast("int")))
    pair = Window.partitionBy("page_id", "block", "level").orderBy("i")
    x = x.withColumn("opened", F.lag(F.struct("kind", "name", "order")).over(pair))
    closes = F.col("kind") == "close"
    nested = F.when(closes, F.coalesce((F.col("opened.kind") == "open") & (F.col("opened.name") == F.col("name")), F.lit(False))).otherwise(F.lit(True))
    number = F.when(closes, 2 * F.col("opened.order") + 1).when(F.col("kind") == "open", 2 * F.col("order"))
    mark = F.when(number.isNotNull(), F.concat(F.lit("[id"), number.cast("string"), F.lit("]")))
    x = x.select("page_id", "block", "i", "piece", mark.alias("mark"), "kind", "foreign", nested.alias("nested"), step.alias("step"))
    each = x.groupBy("page_id", "block").agg(F.array_sort(F.collect_list(F.struct("i", "piece", "mark", "kind"))).alias("x"), F.bool_or("foreign").alias("foreign"), F.bool_and("nested").alias("nested"), F.sum("step").alias("open"))
    raw = F.array_join(F.transform("x", lambda v: F.coalesce(v["piece"], F.lit(""))), "")
    marked = F.array_join(F.transform("x", lambda v: F.coalesce(v["mark"], v["piece"], F.lit(""))), "")
    tags = F.filter("x", lambda v: v["mark"].isNotNull())
    each = each.select("page_id", F.col("block").alias("i"), raw.alias("raw_text"), T.norm(raw).alias("block_text"), F.when(~F.col("foreign") & F.col("nested") & (F.col("open") == 0) & (F.size(tags) > 0), T.norm(marked)).alias("template"), F.transform(tags, lambda v: F.struct(v["mark"].alias("token"), F.upper(v["kind"]).alias("kind"))).alias("tags"))
    both = found.join(each, ["page_id", "i"]).where(~T.non_translatable(F.col("block_text")))
    classes = F.lower(F.regexp_replace(F.regexp_extract("tok", CLASS, 1), "[\"']", ""))
    kept = F.when(T.norm(T.strip_placeholders(F.col("template"))) == F.col("block_text"), F.col("template"))
    out = both.select("page_id", F.col("i").alias("element"), F.col("name").alias("tag"), kind_of(F.col("name"), classes, F.col("quoted")).alias("block_type"), "block_text", "raw_text", kept.alias("template"), "tags")
    return out.withColumn("placeholders", F.when(F.col("template").isNotNull(), F.col("tags"))).drop("tags")
