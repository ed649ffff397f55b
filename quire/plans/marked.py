"""Queries over the blocks of marked-up pages: types, inline placeholders and their checks, typed chunk plans.

The given pages have few kinds of markup, so that seven eighths of them get more by replacement of what is there:
quotations, verse, paragraphs in list items, dialogue, nested and unclosed inline tags, character references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import markup, planning
from quire.plans import relations as R
from quire.plans.catalogue import query

#: Of pages with this remainder by eight: what is replaced by what, one after another.
MORE = {
    1: [("<article>", "<article><blockquote>"), ("</article>", "</blockquote></article>")],
    2: [("<p>", '<p class="Verse first">')],
    3: [("<li>", "<li><p>"), ("</li>", "</p></li>")],
    4: [("</p><p>", "</p><p>“"), ("<p>", "</p><p>")],
    5: [(" the ", " <em>the</em> "), (" of ", ' <b>of <i title="a > b">it</i></b> '), (" la ", " <em>la</em> ")],
    6: [(" in ", " <i>in "), (" de ", ' <a href=">">de</a> '), (" der ", " <!-- <b> -->der ")],
    7: [("<p>", "<pre>"), ("</p>", "</pre>"), (" to ", " &#8212; "), (" que ", " &#x2026;&lt;"), (" die ", " <br/>die ")],
}


def marked(spark, sf) -> DataFrame:
    html = F.col("html")
    for k, pairs in MORE.items():
        new = F.col("html")
        for a, b in pairs:
            new = F.replace(new, F.lit(a), F.lit(b))
        html = F.when(F.col("page_id") % 8 == k, new).otherwise(html)
    return R.table(spark, sf, "pages").select("page_id", html.alias("html"))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_sql, words)) + ")"


def _replaced() -> str:
    out = ""
    for k, pairs in MORE.items():
        new = "html"
        for a, b in pairs:
            new = f"replace({new}, {_sql(a)}, {_sql(b)})"
        out += f" WHEN {k} THEN {new}"
    return f"CASE page_id % 8{out} ELSE html END"


def _decoded(x: str) -> str:
    refs = r"list_distinct(regexp_extract_all({x}, '&#(\d{{1,7}}|[xX][0-9a-fA-F]{{1,6}});', 1))".format(x=x)
    code = "(CASE WHEN n[1] IN ('x', 'X') THEN ('0x' || n[2:])::INT ELSE n::INT END)"
    out = f"list_reduce(list_prepend({x}, {refs}), lambda a, n: replace(a, '&#' || n || ';', chr({code})))"
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")):
        out = f"replace({out}, '&{name};', {_sql(c)})"
    return out


_CLASS = "lower(regexp_replace(regexp_extract(tok, {p}, 1), '[\"'']', '', 'g'))".format(p=_sql(markup.CLASS))
_HAS = lambda words: "regexp_matches(c, {})".format(_sql("|".join(rf"(^|\s){w}(\s|$)|-{w}|{w}-" for w in words)))
_DROP = r"(x = '' OR regexp_matches(x, '(?i)^(https?://|www\.).+') OR regexp_matches(x, '^[\p{P}\p{S}]+$') OR regexp_matches(x, '^\p{N}+$') OR (length(x) <= 3 AND regexp_matches(x, '^[\p{N}\p{P}\p{S}]+$')))"

#: Ends by counting between a start and each end after it; partners of inline ends by depth.
BLOCKS = rf"""
marked AS (SELECT page_id, {_replaced()} AS html FROM pages),
tk AS (SELECT page_id, unnest(l) AS tok, unnest(range(len(l)))::INT AS i FROM (SELECT page_id, regexp_extract_all(html, {_sql(markup.TOKEN)}) AS l FROM marked)),
nm AS (SELECT *, lower(regexp_extract(tok, {_sql(markup.NAME)}, 1)) AS name FROM tk),
t AS (SELECT *, CASE WHEN name IN ('script', 'style') THEN 'none' WHEN name <> '' AND tok LIKE '</%' THEN 'close' WHEN name <> '' AND (name IN {_in(markup.VOID)} OR regexp_matches(tok, '/\s*>$')) THEN 'void' WHEN name <> '' THEN 'open' WHEN regexp_matches(tok, '^<[!?]') THEN 'none' ELSE 'text' END AS kind FROM nm),
upto AS (SELECT page_id, max(i) + 1 AS n FROM t GROUP BY page_id),
pr AS (SELECT b.page_id, b.i, c.i AS ci, sum(CASE d.kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) AS s FROM t b JOIN t c ON c.page_id = b.page_id AND c.name = b.name AND c.kind = 'close' AND c.i > b.i
  JOIN t d ON d.page_id = b.page_id AND d.name = b.name AND d.i > b.i AND d.i <= c.i WHERE b.kind = 'open' AND b.name IN ('li', 'pre', 'figcaption', 'blockquote') GROUP BY ALL),
cl AS (SELECT page_id, i, min(ci) AS j FROM pr WHERE s = -1 GROUP BY ALL),
nx AS (SELECT b.page_id, b.i, min(l.i) AS j FROM t b JOIN t l ON l.page_id = b.page_id AND l.i > b.i AND l.name IN {_in(markup.LEVEL)} AND l.kind IN ('open', 'close', 'void') WHERE b.kind = 'open' AND b.name IN {_in(markup.BLOCKS)} GROUP BY ALL),
qt AS (SELECT q.page_id, q.i, coalesce(cl.j, 1000000000) AS j FROM t q LEFT JOIN cl ON cl.page_id = q.page_id AND cl.i = q.i WHERE q.name = 'blockquote' AND q.kind = 'open'),
iv AS (SELECT b.page_id, b.i, b.name, b.tok, CASE WHEN b.name IN {_in([*markup.HEADINGS, "p"])} THEN coalesce(nx.j, n) ELSE coalesce(cl.j, nx.j, n) END AS j,
    EXISTS (SELECT 1 FROM qt WHERE qt.page_id = b.page_id AND qt.i < b.i AND qt.j > b.i) AS quoted
  FROM t b JOIN upto ON upto.page_id = b.page_id LEFT JOIN nx ON nx.page_id = b.page_id AND nx.i = b.i LEFT JOIN cl ON cl.page_id = b.page_id AND cl.i = b.i WHERE b.kind = 'open' AND b.name IN {_in(markup.BLOCKS)}),
inn AS (SELECT iv.page_id, iv.i AS block, t.i, t.name, CASE WHEN t.name IN {_in(markup.INLINE)} AND t.kind IN ('open', 'close') THEN t.kind END AS kind,
    t.name <> '' AND (t.kind = 'void' OR t.kind = 'open' AND t.name NOT IN {_in(markup.INLINE)}) AS alien, CASE WHEN t.kind = 'text' THEN {_decoded("t.tok")} END AS piece
  FROM iv JOIN t ON t.page_id = iv.page_id AND t.i > iv.i AND t.i < iv.j),
dp AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE kind WHEN 'open' THEN 1 ELSE 0 END) OVER w - 1 AS k FROM inn WINDOW w AS (PARTITION BY page_id, block ORDER BY i)),
op AS (SELECT c.page_id, c.block, c.i, max(o.i) AS oi FROM dp c JOIN dp o ON o.page_id = c.page_id AND o.block = c.block AND o.kind = 'open' AND o.depth = c.depth + 1 AND o.i < c.i WHERE c.kind = 'close' GROUP BY ALL),
mk AS (SELECT c.*, CASE WHEN c.kind = 'open' THEN '[id' || (2 * c.k)::BIGINT || ']' WHEN c.kind = 'close' THEN '[id' || (2 * o.k + 1)::BIGINT || ']' END AS mark, c.kind = 'close' AND o.name IS DISTINCT FROM c.name AS crossed
  FROM dp c LEFT JOIN op ON op.page_id = c.page_id AND op.block = c.block AND op.i = c.i LEFT JOIN dp o ON o.page_id = c.page_id AND o.block = c.block AND o.i = op.oi),
ag AS (SELECT page_id, block, coalesce(string_agg(piece, '' ORDER BY i), '') AS raw_text, string_agg(coalesce(mark, piece), '' ORDER BY i) AS marks, bool_or(alien) OR bool_or(crossed) OR sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) <> 0 AS bad,
    coalesce(list(mark ORDER BY i) FILTER (mark IS NOT NULL), []) AS tokens, coalesce(list(upper(kind) ORDER BY i) FILTER (mark IS NOT NULL), []) AS kinds FROM mk GROUP BY page_id, block),
bt AS (SELECT iv.page_id, iv.i AS element, iv.name AS tag, iv.quoted, {_CLASS} AS c, raw_text, {R.NORM.format(x="raw_text")} AS block_text, CASE WHEN NOT bad AND len(tokens) > 0 THEN {R.NORM.format(x="marks")} END AS template, tokens, kinds FROM iv JOIN ag ON ag.page_id = iv.page_id AND ag.block = iv.i),
kept AS (SELECT *, regexp_replace(block_text, '\s+', '', 'g') AS x FROM bt),
blocks AS (SELECT page_id, element, row_number() OVER (PARTITION BY page_id ORDER BY element)::INT AS segment_order, tag, block_text, raw_text, template, tokens, kinds,
    CASE WHEN tag LIKE 'h%' THEN 'TITLE' WHEN tag = 'li' THEN 'LIST_ITEM' WHEN tag = 'pre' OR {_HAS(markup.VERSE)} THEN 'POETRY' WHEN quoted OR {_HAS(markup.QUOTE)} THEN 'QUOTE' WHEN tag = 'figcaption' THEN 'IMAGE_CAPTION' WHEN tag = 'p' THEN 'PARAGRAPH' ELSE 'OTHER' END AS block_type
  FROM kept WHERE NOT {_DROP}),
templates AS (SELECT page_id, element, block_text, template, tokens, kinds FROM blocks WHERE template IS NOT NULL AND {R.NORM.format(x="regexp_replace(template, '[[]id[0-9]+[]]', '', 'g')")} = block_text)"""


def _templates(spark, sf) -> DataFrame:
    b = markup.blocks(marked(spark, sf)).where("template is not null")
    return b.select("page_id", "element", "block_text", "template", "placeholders", F.transform("placeholders", lambda p: p["token"]).alias("tokens"))


@query(f"WITH {BLOCKS} SELECT page_id, element, segment_order, tag, block_text, block_type FROM blocks")
def block_extract(spark, sf):
    order = F.row_number().over(Window.partitionBy("page_id").orderBy("element"))  # a page is a row
    return markup.blocks(marked(spark, sf)).select("page_id", "element", order.alias("segment_order"), "tag", "block_text", "block_type")


@query(f"WITH {BLOCKS} SELECT page_id, element, template, tokens, array_to_string(kinds, ' ') AS kinds, sha256(template) AS digest FROM templates")
def inline_templates(spark, sf):
    kinds = F.array_join(F.transform("placeholders", lambda p: p["kind"]), " ")
    return _templates(spark, sf).select("page_id", "element", "template", "tokens", kinds.alias("kinds"), F.sha2("template", 256).alias("digest"))


#: Translations of templates with a fault by id: none, lost, twice, swapped, unknown, blank, crossed.
_FAULTY = """told AS (SELECT *, CASE (page_id + element) % 7 WHEN 0 THEN template WHEN 1 THEN replace(template, '[id1]', '') WHEN 2 THEN replace(template, '[id0]', '[id0][id0]') WHEN 3 THEN replace(replace(replace(template, '[id0]', '[x]'), '[id1]', '[id0]'), '[x]', '[id1]')
  WHEN 4 THEN template || '[id99] [id98][id99]' WHEN 5 THEN ' ' ELSE replace(template, '[id0]', '') || '[id0]' END AS told FROM templates)"""


def _told(spark, sf) -> DataFrame:
    t = F.col("template")
    r = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    case = (F.col("page_id") + F.col("element")) % 7
    told = (
        F.when(case == 0, t).when(case == 1, r(t, "[id1]", "")).when(case == 2, r(t, "[id0]", "[id0][id0]")).when(case == 3, r(r(r(t, "[id0]", "[x]"), "[id1]", "[id0]"), "[x]", "[id1]"))
        .when(case == 4, F.concat(t, F.lit("[id99] [id98][id99]"))).when(case == 5, " ").otherwise(F.concat(r(t, "[id0]", ""), F.lit("[id0]")))
    )
    return _templates(spark, sf).withColumn("told", told)


@query(
    rf"""WITH {BLOCKS}, {_FAULTY}, a AS (SELECT page_id, element, told, tokens AS ex, regexp_extract_all(told, '[[]id[0-9]+[]]') AS act FROM told),
    b AS (SELECT *, list_filter(act, lambda y: NOT list_contains(ex, y)) AS extra, list_filter(ex, lambda y: NOT list_contains(act, y)) AS miss, list_filter(act, lambda y: len(list_filter(act, lambda z: z = y)) > 1) AS twice FROM a),
    once AS (SELECT *, list_filter(extra, lambda y, i: list_position(extra, y) = i) AS extra1, list_filter(twice, lambda y, i: list_position(twice, y) = i) AS twice1 FROM b)
    SELECT page_id, element, len(act)::INT AS n_found, CASE WHEN trim(told) = '' THEN 'no placeholder is left' WHEN len(extra) > 0 THEN 'placeholders too many: ' || array_to_string(extra1, ', ') WHEN len(miss) > 0 THEN 'placeholders lost: ' || array_to_string(miss, ', ')
      WHEN len(twice) > 0 THEN 'placeholders twice: ' || array_to_string(twice1, ', ') WHEN act <> ex THEN 'placeholders in another order' END AS fault FROM once"""
)
def placeholder_validate(spark, sf):
    fault = T.placeholder_fault(F.col("tokens"), F.col("told"))
    return _told(spark, sf).select("page_id", "element", F.size(T.placeholders(F.col("told"))).alias("n_found"), fault.alias("fault"))


@query(
    rf"""WITH RECURSIVE {BLOCKS}, {_FAULTY}, a AS (SELECT page_id, element, tokens, kinds, regexp_extract_all(told, '[[]id[0-9]+[]]') AS act FROM told),
    st AS (SELECT page_id, element, tokens, kinds, act, 1 AS i, []::VARCHAR[] AS stack, NULL::VARCHAR AS fault FROM a
      UNION ALL SELECT page_id, element, tokens, kinds, act, i + 1,
        CASE WHEN list_position(tokens, act[i]) IS NULL THEN stack WHEN kinds[list_position(tokens, act[i])] = 'OPEN' THEN list_append(stack, act[i]) ELSE stack[:len(stack) - 1] END,
        CASE WHEN list_position(tokens, act[i]) IS NULL THEN 'unknown placeholder ' || act[i] WHEN kinds[list_position(tokens, act[i])] = 'CLOSE' AND (len(stack) = 0 OR '[id' || (regexp_extract(stack[len(stack)], '[0-9]+')::INT + 1) || ']' <> act[i]) THEN 'placeholders cross at ' || act[i] END
      FROM st WHERE i <= len(act) AND fault IS NULL)
    SELECT page_id, element, CASE WHEN fault IS NULL AND len(stack) > 0 THEN 'never closed: ' || stack[len(stack)] ELSE fault END AS fault FROM st WHERE fault IS NOT NULL OR i > len(act)"""
)
def placeholder_nesting(spark, sf):
    return _told(spark, sf).select("page_id", "element", T.nesting_fault(F.col("placeholders"), F.col("told")).alias("fault"))


@query(rf"WITH {BLOCKS}, {_FAULTY} SELECT page_id, element, template AS source, {R.NORM.format(x="regexp_replace(told, '[[]id[0-9]+[]]', '', 'g')")} AS shown FROM told WHERE (page_id + element) % 7 <> 4")
def strip_placeholders(spark, sf):
    """What goes to a provider, and what a reader sees of its answer: placeholders that are known go, others stay."""
    t = _told(spark, sf).where("(page_id + element) % 7 <> 4")
    source = T.provider_source(F.col("block_text"), F.col("template"), F.col("tokens"))
    return t.select("page_id", "element", source.alias("source"), T.display(F.col("told"), F.col("tokens")).alias("shown"))


_SAID = r"regexp_matches(trim(block_text), '^([\"''“‘—]|- )|[\"”]$') OR regexp_matches(lower(trim(block_text)), '^(he said|she said|said )')".replace('\\"', '"')


@query(
    rf"""WITH {BLOCKS}, f AS (SELECT page_id, element, block_type = 'PARAGRAPH' AND ({_SAID}) AS dialogue FROM blocks),
    c AS (SELECT *, CASE WHEN dialogue AND lag(dialogue) OVER (PARTITION BY page_id ORDER BY element) THEN 0 ELSE 1 END AS new FROM f)
    SELECT page_id, element, dialogue, (sum(new) OVER (PARTITION BY page_id ORDER BY element))::BIGINT AS run FROM c"""
)
def dialogue_runs(spark, sf):
    w = Window.partitionBy("page_id").orderBy("element")
    said = (F.col("block_type") == "PARAGRAPH") & T.is_dialogue(F.col("block_text"))
    f = markup.blocks(marked(spark, sf)).select("page_id", "element", said.alias("dialogue"))
    c = f.withColumn("new", F.when(F.col("dialogue") & F.lag("dialogue").over(w), 0).otherwise(1))
    return c.select("page_id", "element", "dialogue", F.sum("new").over(w).alias("run"))


#: Chunks of ten blocks and 3,000 characters: a recursion over blocks gives units, one over units gives chunks.
_MOST, _TARGET = 10, 3000
_UNITS = rf"""
s AS (SELECT page_id, element, length(block_text) AS z, block_type = 'TITLE' AS title, row_number() OVER (PARTITION BY page_id ORDER BY element) AS i,
    CASE WHEN block_type IN ('LIST_ITEM', 'QUOTE', 'POETRY') THEN block_type WHEN block_type = 'PARAGRAPH' AND ({_SAID}) THEN 'dialogue' END AS run FROM blocks),
f AS (SELECT page_id, i, run, z AS uz, 1 AS un, 0 AS unit FROM s WHERE i = 1
  UNION ALL SELECT s.page_id, s.i, s.run, CASE WHEN s.run = f.run AND un < {_MOST} AND uz + s.z <= {_TARGET} THEN uz + s.z ELSE s.z END, CASE WHEN s.run = f.run AND un < {_MOST} AND uz + s.z <= {_TARGET} THEN un + 1 ELSE 1 END,
    CASE WHEN s.run = f.run AND un < {_MOST} AND uz + s.z <= {_TARGET} THEN unit ELSE unit + 1 END FROM f JOIN s ON s.page_id = f.page_id AND s.i = f.i + 1),
u AS (SELECT s.page_id, unit, count(*) AS n, sum(z) AS z, bool_or(title) AS title, list(element ORDER BY s.i) AS ids FROM s JOIN f ON f.page_id = s.page_id AND f.i = s.i GROUP BY s.page_id, unit),
tk2 AS (SELECT *, coalesce(lag(title) OVER w AND NOT title AND n + 1 <= {_MOST} AND lag(z) OVER w + z <= {_TARGET}, false) AS taken FROM u WINDOW w AS (PARTITION BY page_id ORDER BY unit)),
m AS (SELECT page_id, unit - taken::INT AS unit, sum(n) AS n, sum(z) AS z, bool_or(title) AS titled, flatten(list(ids ORDER BY unit)) AS ids FROM tk2 GROUP BY ALL),
mi AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY unit) AS i FROM m),
g AS (SELECT page_id, i, n AS cn, z AS cz, 0::BIGINT AS chunk FROM mi WHERE i = 1
  UNION ALL SELECT mi.page_id, mi.i, CASE WHEN titled OR cn + n > {_MOST} OR cz + z > {_TARGET} THEN n ELSE cn + n END, CASE WHEN titled OR cn + n > {_MOST} OR cz + z > {_TARGET} THEN z ELSE cz + z END,
    CASE WHEN titled OR cn + n > {_MOST} OR cz + z > {_TARGET} THEN chunk + 1 ELSE chunk END FROM g JOIN mi ON mi.page_id = g.page_id AND mi.i = g.i + 1)"""


def _segments(spark, sf) -> DataFrame:
    b = markup.blocks(marked(spark, sf))
    return b.select(F.col("page_id").alias("chapter_id"), F.col("element").alias("segment_order"), F.col("element").alias("segment_id"), F.col("block_text").alias("source_text"), F.col("block_type").alias("segment_type"))


@query(f"WITH RECURSIVE {BLOCKS}, {_UNITS} SELECT page_id, unit::BIGINT AS unit, n::BIGINT AS n_segments, z::BIGINT AS chars, titled, ids AS elements FROM m")
def semantic_units(spark, sf):
    u = planning.units(_segments(spark, sf), target=_TARGET, most=_MOST)
    return u.select(F.col("chapter_id").alias("page_id"), F.col("unit").cast("long").alias("unit"), "n_segments", "chars", "titled", F.col("segment_ids").alias("elements"))


@query(f"WITH RECURSIVE {BLOCKS}, {_UNITS} SELECT mi.page_id, chunk, sum(n)::BIGINT AS n_segments, sum(z)::BIGINT AS chars, flatten(list(ids ORDER BY mi.i)) AS elements FROM mi JOIN g ON g.page_id = mi.page_id AND g.i = mi.i GROUP BY mi.page_id, chunk")
def typed_chunk_plan(spark, sf):
    p = planning.chunk_plan(_segments(spark, sf), target=_TARGET, most=_MOST)
    return p.select(F.col("chapter_id").alias("page_id"), F.col("chunk").cast("long").alias("chunk"), "n_segments", "chars", F.col("segment_ids").alias("elements"))
