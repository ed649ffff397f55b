"""More queries over whole tables: chunk context and lineage, effective terms, counters, reports as lines."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import paragraphs as P
from quire.functions import text as T
from quire.operators import glossary as G
from quire.operators import planning, progress, quality
from quire.operators.sequence import dealt, number
from quire.plans import catalogue as C
from quire.plans import relations as R
from quire.plans.catalogue import query
from quire.sources import changes, library, scratch

# -- chunks ------------------------------------------------------------------------------------------


@query(
    f"""{C.PLAN}, a AS (SELECT chapter_id, chunk, segment_ids[1] AS first_id FROM plan),
    done AS (SELECT chapter_id, segment_id FROM segments WHERE status = 'TRANSLATED' AND trim(translated_text) <> '')
    SELECT a.chapter_id, chunk, coalesce((SELECT list(segment_id ORDER BY segment_id) FROM (SELECT segment_id FROM done WHERE done.chapter_id = a.chapter_id AND done.segment_id < first_id ORDER BY segment_id DESC LIMIT 4)), []) AS context FROM a"""
)
def chunk_context(spark, sf):
    s = R.segments(spark, sf)
    return planning.chunk_context(planning.chunk_plan(s), s)


@query(
    f"""{C.PLAN}, ids AS (SELECT chapter_id, chunk, CASE WHEN chapter_id % 13 = 0 THEN list_append(segment_ids, -1) ELSE segment_ids END AS ids FROM plan),
    x AS (SELECT chapter_id, chunk, unnest(ids) AS segment_id, unnest(range(len(ids)))::INT AS position FROM ids)
    SELECT x.chapter_id, chunk, position, x.segment_id, source_text, s.segment_id IS NULL AS missing FROM x LEFT JOIN segments s ON x.segment_id = s.segment_id"""
)
def chunk_segments(spark, sf):
    s = R.segments(spark, sf)
    plan = planning.chunk_plan(s).withColumn("segment_ids", F.when(F.col("chapter_id") % 13 == 0, F.array_append("segment_ids", F.lit(-1).cast("long"))).otherwise(F.col("segment_ids")))
    return planning.chunk_segments(plan, s)


@query(
    f"""{C.PLAN}, h AS (SELECT *, ceil(len(segment_ids) / 2)::INT AS half FROM plan WHERE len(segment_ids) > 1), kids AS (SELECT chapter_id, chunk AS parent, unnest([chunk * 1000, chunk * 1000 + 1])::BIGINT AS child_order, unnest([half, len(segment_ids) - half])::BIGINT AS n_child FROM h)
    SELECT plan.chapter_id, chunk, n_segments, child_order, n_child FROM plan LEFT JOIN kids ON plan.chapter_id = kids.chapter_id AND plan.chunk = kids.parent"""
)
def chunk_lineage(spark, sf):
    """Parents with their children, side by side in one table of chunks."""
    plan = planning.chunk_plan(R.segments(spark, sf)).withColumn("depth", F.lit(0))
    kids = planning.split_chunks(plan).select("chapter_id", "parent", F.col("child_order").alias("order"), F.size("segment_ids").cast("long").alias("n"))
    chunks = plan.select("chapter_id", F.lit(None).cast("long").alias("parent"), F.col("chunk").alias("order"), F.col("n_segments").alias("n")).unionByName(kids)
    children = chunks.where("parent is not null").select("chapter_id", F.col("parent").alias("chunk"), F.col("order").alias("child_order"), F.col("n").alias("n_child"))
    parents = chunks.where("parent is null").select("chapter_id", F.col("order").alias("chunk"), F.col("n").alias("n_segments"))
    return parents.join(children, ["chapter_id", "chunk"], "left")


@query(
    """WITH p AS (SELECT l_orderkey AS segment_id, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linenumber - 1 AS i, l_orderkey AS k FROM lineitem),
    q AS (SELECT segment_id, CASE WHEN k % 11 <> 0 THEN i END AS part_index, CASE WHEN k % 11 <> 0 THEN n + (k % 7 = 0)::INT END AS part_count FROM p)
    SELECT segment_id, count(*) AS n_parts, CASE WHEN count(part_index) = 0 AND count(part_count) = 0 THEN count(*) = 1 ELSE coalesce(count(part_index) = count(*) AND min(part_index) = 0 AND max(part_index) = count(*) - 1 AND count(DISTINCT part_index) = count(*) AND min(part_count) = count(*) AND max(part_count) = count(*) AND count(part_count) = count(*), false) END AS valid FROM q GROUP BY segment_id"""
)
def part_sequence_check(spark, sf):
    x = R.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("i"))
    x = dealt(x, "k")
    n = x.groupBy("k").agg(F.count("*").alias("n"))
    told = x.join(n, "k").select(F.col("k").alias("segment_id"), F.when(F.col("k") % 11 != 0, F.col("i")).alias("part_index"), F.when(F.col("k") % 11 != 0, F.col("n") + (F.col("k") % 7 == 0).cast("int")).alias("part_count"))
    return planning.part_sequence_check(told)


@query("SELECT c_custkey AS book_id, sha256(j) AS snapshot_hash, substr(sha256(j), 1, 32) AS prompt_version FROM (SELECT *, '{\"genre\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || ',\"target_language\":\"zh\"}' AS j FROM customer)")
def snapshot_hash(spark, sf):
    return _snapshots(spark, sf).select("book_id", "snapshot_hash", F.substring("snapshot_hash", 1, 32).alias("prompt_version"))


def _snapshots(spark, sf):
    c = R.table(spark, sf, "customer")
    rules = F.struct(F.col("c_mktsegment").alias("genre"), F.col("c_nationkey").alias("nation"), F.lit("zh").alias("target_language"))  # names in order
    return c.select(F.col("c_custkey").alias("book_id"), F.sha2(F.to_json(rules), 256).alias("snapshot_hash"))


@query("WITH h AS (SELECT c_custkey AS book_id, sha256('{\"genre\":\"' || c_mktsegment || '\",\"nation\":' || c_nationkey || ',\"target_language\":\"zh\"}') AS snapshot_hash FROM customer) SELECT snapshot_hash, min(book_id) AS first_book_id FROM h WHERE snapshot_hash NOT IN (SELECT snapshot_hash FROM h WHERE book_id % 10 = 0) GROUP BY snapshot_hash")
def snapshot_insert(spark, sf):
    """New snapshots by content: those of the books of full tens are there already."""
    h = _snapshots(spark, sf)
    new = h.join(h.where("book_id % 10 = 0").select("snapshot_hash"), "snapshot_hash", "left_anti")
    return new.groupBy("snapshot_hash").agg(F.min("book_id").alias("first_book_id"))


# -- terms and counters ------------------------------------------------------------------------------


@query(
    f"""{C.TERMS}, {R.GLOSSARY_SQL}, a AS (SELECT lower(trim(source_term)) AS source_norm, trim(source_term) AS source_term, nullif(trim(target_term), '') AS target_term FROM glossary),
    b AS (SELECT book_id, source_norm, term, upper(term) AS t FROM terms WHERE rank % 3 = 0)
    SELECT NULL::INT AS book_id, source_norm, source_term, target_term FROM a UNION ALL SELECT book_id, b.source_norm, coalesce(a.source_term, term), t FROM b LEFT JOIN a ON a.source_norm = b.source_norm WHERE a.target_term IS NULL"""
)
def effective_glossary(spark, sf):
    accepted = G.first_terms(R.segments(spark, sf), 12).where("rank % 3 = 0").select("book_id", "source_norm", "term", F.upper("term").alias("target_term"))
    return G.effective(R.glossary(spark), accepted)


_SUMS = "sum(added)::BIGINT AS added, sum(updated)::BIGINT AS updated, sum(filled)::BIGINT AS filled, sum(conflicts)::BIGINT AS conflicts, (SELECT count(*) FROM gl WHERE book_id % 2 = 1 AND trim(s) = '') AS skipped"


@query(f"SELECT 'fill' AS mode, * FROM ({C.FILL} SELECT {_SUMS} FROM merged) UNION ALL SELECT 'overwrite', * FROM ({C.OVER} SELECT {_SUMS} FROM merged)")
def merge_counters(spark, sf):
    there, come = C._glossaries(spark, sf)
    of = lambda mode: G.counters(G.merge(there, come, mode), come)
    return of("FILL_EMPTY").select(F.lit("fill").alias("mode"), "*").unionByName(of("OVERWRITE").select(F.lit("overwrite").alias("mode"), "*"))


@query(f"{C.CANDIDATES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score, n_warnings DESC, segment_id) AS rank FROM cand) SELECT book_id, count(*) AS candidates, count_if(rank <= 20)::BIGINT AS selected, count_if(rank <= 20 AND segment_id % 3 <> 0)::BIGINT AS updated FROM ranked GROUP BY book_id")
def review_counters(spark, sf):
    c = scratch.stage(quality.review_candidates(C._scored(spark, sf)).select("book_id", "segment_id", "score", "n_warnings"), "candidates")  # read three times
    updated = quality.review_top(c).where("segment_id % 3 <> 0").select("segment_id")
    return quality.review_counters(c, updated)


@query(f"{C.CACHE} SELECT keyed.cache_key, count(*) AS hit_count, max(segment_id) AS last_used FROM keyed JOIN cache ON keyed.cache_key = cache.cache_key WHERE book_id >= 10 GROUP BY keyed.cache_key")
def cache_usage(spark, sf):
    used = C._keyed(spark, sf).where("book_id >= 10").groupBy("cache_key").agg(F.count("*").alias("hit_count"), F.max("segment_id").alias("last_used"))
    return used.join(C._cache(spark, sf), "cache_key", "left_semi")


@query(f"{C.JOBS}, t AS (SELECT *, CASE WHEN job_id % 5 <> 0 THEN updated_at END AS started_at FROM jobs) SELECT job_id, book_id FROM t WHERE status = 'RUNNING' AND started_at < TIMESTAMP '{C.NOW}' - INTERVAL 30 MINUTE")
def stale_jobs(spark, sf):
    started = R.jobs(spark, sf).withColumn("started_at", F.when(F.col("job_id") % 5 != 0, F.col("updated_at")))
    return progress.stale(started, F.lit(C.NOW).cast("timestamp_ntz")).select("job_id", "book_id")


# -- order, texts and reports ------------------------------------------------------------------------


@query(f"{C.SEG} SELECT book_id, segment_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_id, segment_order)::INT AS position FROM segments")
def reading_order(spark, sf):
    s = R.segments(spark, sf).select("book_id", "chapter_id", "segment_order", "segment_id")
    return number(s, ["book_id"], F.col("chapter_id"), F.col("segment_order")).select("book_id", "segment_id", F.col("position").cast("int").alias("position"))


@query(" UNION ALL ".join(f"SELECT chapter_id, segment_id, {asked} AS asked FROM ({C.SEG} SELECT * FROM segments WHERE trim(source_text) <> '' QUALIFY row_number() OVER (PARTITION BY chapter_id ORDER BY segment_order) <= {k})" for asked, k in (("NULL::INT", 120), ("30", 30), ("9999", 500), ("0", 1))))
def first_k_per_chapter(spark, sf):
    """The first segments of each chapter that an analysis looks at: by default, as asked for, and within its bounds."""
    s = R.segments(spark, sf).where("trim(source_text) <> ''").select("chapter_id", "segment_id", "segment_order")
    of = lambda asked: progress.latest(s, ["chapter_id"], F.col("segment_order"), k=G.analysis_limit(asked)).select("chapter_id", "segment_id", F.lit(asked).cast("int").alias("asked"))
    return of(None).unionByName(of(30)).unionByName(of(9999)).unionByName(of(0))


_RAW = "' ' || source_text || chr(160) || '  ' || chr(10) || chr(10) || chr(10) || chr(10) || lower(source_text) || chr(9) || ' '"


@query(rf"{C.SEG} SELECT segment_id, regexp_replace(regexp_replace(regexp_replace(replace({_RAW}, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS processed FROM segments")
def post_process(spark, sf):
    raw = F.concat(F.lit(" "), "source_text", F.lit("   \n\n\n\n"), F.lower("source_text"), F.lit("\t "))
    return R.segments(spark, sf).select("segment_id", T.post_process(raw).alias("processed"))


@query(
    rf"""{C.SEG}, {R.NOTES} SELECT book_id, i, note_id, CASE WHEN i = 1 THEN '# My Notes - ' || book_title || chr(10) || chr(10) ELSE '' END || CASE WHEN new_heading THEN '## ' || chapter_title || chr(10) || chr(10) ELSE '' END
      || '**Segment ' || segment_order || '** (' || created_at::DATE::VARCHAR || ')' || chr(10) || '> ' || source_text || chr(10)
      || CASE WHEN translated_text IS NULL THEN '' ELSE '> ' || regexp_replace(translated_text, '\[id\d+\]', '', 'g') || chr(10) END || chr(10) || '**Note:** ' || note_content || chr(10) || chr(10) AS markdown FROM headed"""
)
def notes_markdown(spark, sf):
    """A book's notes as Markdown, one row a note by its place: no book is held whole."""
    return quality.notes_markdown(R.noted(spark, sf))


_MESSAGE = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quality.MESSAGES.items()) + " END"
_SEVERITY = f"CASE WHEN code IN {quality.ERRORS} THEN 'error' ELSE 'warning' END"
_REPORT = f"""{C.SCORED}, w AS (SELECT book_id, segment_id, segment_order, source_text, unnest(range(len(reasons)))::INT AS position, unnest(reasons) AS code FROM scored),
  nw AS (SELECT book_id, count(*) AS n, count_if(code = 'glossary_term_missing') AS nt FROM w GROUP BY book_id),
  s AS (SELECT book_id, count(*) AS total, count_if(status = 'TRANSLATED')::BIGINT AS translated, count_if(status = 'FAILED')::BIGINT AS failed, floor(avg(score) + 0.5)::BIGINT AS quality FROM scored GROUP BY book_id),
  c AS (SELECT s.*, coalesce(n, 0)::BIGINT AS n_warnings, coalesce(nt, 0)::BIGINT AS n_terms FROM s LEFT JOIN nw USING (book_id))"""


@query(
    f"""{_REPORT}
    SELECT book_id, 0 AS section, -1::BIGINT AS segment_id, 0 AS position, '# Consistency Report' || chr(10) || chr(10) || '- Book ID: ' || book_id || chr(10) || '- Total segments: ' || total || chr(10) || '- Translated segments: ' || translated || chr(10) || '- Failed segments: ' || failed || chr(10) || '- Quality score: ' || quality || chr(10) || '- Warnings: ' || n_warnings || chr(10) || '- Term warnings: ' || n_terms || chr(10) AS markdown FROM c
    UNION ALL SELECT book_id, 1, -1, 0, chr(10) || CASE WHEN n_warnings = 0 THEN 'No warnings.' || chr(10) ELSE '## Warnings' || chr(10) || chr(10) END FROM c
    UNION ALL SELECT book_id, 2, -1, 0, chr(10) || '## Segment Scores' || chr(10) || chr(10) FROM c
    UNION ALL SELECT book_id, 1, segment_id, position, '- [' || {_SEVERITY} || '] ' || code || ' segment ' || segment_id || ': ' || {_MESSAGE} || chr(10) FROM w
    UNION ALL SELECT book_id, 2, segment_id, 0, '- Segment ' || segment_id || ': ' || score || '/100' || CASE WHEN len(reasons) > 0 THEN ' (' || array_to_string(reasons, ', ') || ')' ELSE '' END || chr(10) FROM scored"""
)
def report_markdown(spark, sf):
    """A book's report as Markdown, one row a line in the order of the keys: no book is held whole."""
    return quality.report_markdown(C._scored(spark, sf))


@query(
    f"""{_REPORT}
    SELECT book_id, 'head' AS part, -1::BIGINT AS segment_id, 0 AS position, '{{"book_id":' || book_id || ',"total":' || total || ',"translated":' || translated || ',"failed":' || failed || ',"score":' || quality || ',"n_warnings":' || n_warnings || ',"n_terms":' || n_terms || '}}' AS json FROM c
    UNION ALL SELECT book_id, 'score', segment_id, 0, '{{"segment_id":' || segment_id || ',"segment_order":' || segment_order || ',"score":' || score || ',"reasons":[' || array_to_string(list_transform(reasons, lambda y: '"' || y || '"'), ',') || ']}}' FROM scored
    UNION ALL SELECT book_id, 'warning', segment_id, position, '{{"code":"' || code || '","severity":"' || {_SEVERITY} || '","segment_id":' || segment_id || ',"segment_order":' || segment_order || ',"message":"' || {_MESSAGE} || '","source_text":' || to_json(CASE WHEN length(source_text) <= 160 THEN source_text ELSE substr(source_text, 1, 157) || '...' END)::VARCHAR || '}}' FROM w"""
)
def report_json(spark, sf):
    return quality.report_json(C._scored(spark, sf))


# -- ingest, locators, acceptance --------------------------------------------------------------------


@query(f"{C.SEG} SELECT book_id, count(DISTINCT chapter_id) AS chapters, count(*) AS segments FROM segments GROUP BY book_id")
def ingest_counts(spark, sf):
    return progress.ingest_counts(R.segments(spark, sf))


@query("SELECT c_nationkey AS owner_id, c_custkey AS book_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC)::INT AS position FROM customer")
def books_of_owner(spark, sf):
    books = R.table(spark, sf, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("book_id"))
    return number(books, ["owner_id"], F.desc("book_id")).withColumn("position", F.col("position").cast("int"))


@query(f"WITH {R.CHUNKS} SELECT job_id, line, status, row_number() OVER (PARTITION BY job_id ORDER BY line, status)::INT AS position FROM chunks")
def chunk_order(spark, sf):
    c = number(R.chunks(spark, sf).select("job_id", "line", "status"), ["job_id"], F.col("line"), F.col("status"))
    return c.withColumn("position", F.col("position").cast("int"))


@query("SELECT ts::DATE AS day, user_id AS author_id, count(*) AS notes FROM events GROUP BY ALL")
def notes_by_date(spark, sf):
    return R.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("author_id")).agg(F.count("*").alias("notes"))


@query(
    f"""{C.SEG}, x AS (SELECT segment_id, segment_order AS o, 'chapter' || chapter_id || '.xhtml' AS p, list_transform(range(1, segment_order % 3 + 1), lambda i: '[id' || i || ']') AS t FROM segments)
    SELECT segment_id, '{{"path":"' || p || '","index":' || o || CASE WHEN len(t) > 0 THEN ',"tokens":["' || array_to_string(t, '","') || '"]' ELSE '' END || '}}' AS locator,
      CASE WHEN o % 7 <> 0 THEN p END AS path, CASE WHEN o % 7 <> 0 THEN o END::INT AS index, CASE WHEN o % 7 <> 0 THEN len(t) ELSE 0 END::INT AS n_tokens FROM x"""
)
def locator_json(spark, sf):
    """Places written and read again: every fifth with a field that is not known, every seventh cut short."""
    o = F.col("segment_order")
    tokens = F.transform(F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (o % 3).cast("int")), lambda i: F.concat(F.lit("[id"), i.cast("string"), F.lit("]")))
    path = F.concat(F.lit("chapter"), F.col("chapter_id").cast("string"), F.lit(".xhtml"))
    s = R.segments(spark, sf).select("segment_id", "segment_order", T.locator_json(path, o.cast("int"), tokens).alias("locator"))
    told = F.when(o % 7 == 0, F.substring("locator", F.lit(1), F.lit(9))).when(o % 5 == 0, F.regexp_replace("locator", r"^\{", '{"tag":"p",')).otherwise(F.col("locator"))
    s = s.withColumn("x", T.read_locator(told))
    return s.select("segment_id", "locator", "x.path", "x.index", F.coalesce(F.size("x.tokens"), F.lit(0)).alias("n_tokens")).withColumn("n_tokens", F.greatest("n_tokens", F.lit(0)))


@query(f"""{C.PLAN} SELECT chapter_id, chunk, '[' || array_to_string(segment_ids, ',') || ']' AS ids_json, CASE WHEN chapter_id % 4 <> 0 THEN segment_ids END AS ids FROM plan""")
def segment_ids_json(spark, sf):
    """Lists of ids written and read again: of every fourth chapter they are cut short."""
    p = planning.chunk_plan(R.segments(spark, sf)).select("chapter_id", "chunk", T.ids_json(F.col("segment_ids")).alias("ids_json"))
    told = F.when(F.col("chapter_id") % 4 == 0, F.lit('[12, "')).otherwise(F.col("ids_json"))
    return p.withColumn("ids", T.read_ids(told))


_ACCEPT = f"""{C.TERMS}, configured AS (SELECT source_norm, min(upper(term)) AS target_term FROM terms WHERE rank % 2 = 1 GROUP BY source_norm),
  cand AS (SELECT book_id, source_norm, CASE WHEN rank % 5 = 0 THEN ' ' WHEN book_id % 2 = 0 THEN upper(term) ELSE lower(term) END AS target_term FROM terms),
  accepted AS (SELECT book_id, cand.source_norm, cand.target_term, CASE WHEN trim(cand.target_term) = '' THEN 'PENDING' WHEN configured.target_term <> trim(cand.target_term) THEN 'CONFLICT' ELSE 'ACCEPTED' END AS status FROM cand LEFT JOIN configured ON configured.source_norm = cand.source_norm)"""


def _accepted(spark, sf):
    t = C.first_terms(spark, sf)
    configured = t.where("rank % 2 = 1").groupBy("source_norm").agg(F.min(F.upper("term")).alias("target_term"))
    target = F.when(F.col("rank") % 5 == 0, " ").when(F.col("book_id") % 2 == 0, F.upper("term")).otherwise(F.lower("term"))
    return G.accept(t.select("book_id", "source_norm", target.alias("target_term")), configured)


@query(f"{_ACCEPT} SELECT * FROM accepted")
def glossary_acceptance(spark, sf):
    return _accepted(spark, sf)


@query(f"{_ACCEPT} SELECT book_id, count_if(status = 'ACCEPTED')::BIGINT AS accepted, count_if(status = 'CONFLICT')::BIGINT AS conflicts, count_if(status = 'PENDING')::BIGINT AS pending FROM accepted GROUP BY book_id")
def acceptance_counters(spark, sf):
    return G.acceptance_counters(_accepted(spark, sf))


@query(
    f"""{C.PLAN}, {R.GLOSSARY_SQL}, done AS (SELECT chapter_id, segment_id, source_text FROM segments WHERE status = 'TRANSLATED' AND trim(translated_text) <> ''),
    own AS (SELECT chapter_id, chunk, unnest(segment_ids) AS segment_id FROM plan),
    ctx AS (SELECT plan.chapter_id, chunk, source_text, row_number() OVER (PARTITION BY plan.chapter_id, chunk ORDER BY done.segment_id DESC) AS i FROM plan JOIN done ON done.chapter_id = plan.chapter_id AND done.segment_id < segment_ids[1]),
    bag AS (SELECT own.chapter_id, chunk, source_text AS text FROM own JOIN segments USING (segment_id) UNION ALL SELECT chapter_id, chunk, source_text FROM ctx WHERE i <= 4 UNION ALL SELECT chapter_id, chunk, 'Chapter ' || chapter_id || ' there' FROM plan WHERE chapter_id % 10 = 0)
    SELECT chapter_id, chunk, list_sort(list(DISTINCT trim(source_term))) AS terms FROM bag JOIN glossary ON contains(lower(text), lower(trim(source_term))) GROUP BY chapter_id, chunk"""
)
def chunk_glossary(spark, sf):
    """Terms of a chunk: those in its own segments, in the context before it and in the chapter's title."""
    s = R.segments(spark, sf)
    plan = planning.chunk_plan(s)
    ids = plan.select("chapter_id", "chunk", F.explode("segment_ids").alias("segment_id"))
    before = planning.chunk_context(plan, s).select("chapter_id", "chunk", F.explode("context").alias("segment_id"))
    texts = ids.unionByName(before).join(s.select("segment_id", F.col("source_text").alias("text")), "segment_id").select("chapter_id", "chunk", "text")
    titles = plan.where("chapter_id % 10 = 0").select("chapter_id", "chunk", F.concat(F.lit("Chapter "), F.col("chapter_id").cast("string"), F.lit(" there")).alias("text"))
    return G.found_in(texts.unionByName(titles), ["chapter_id", "chunk"], R.glossary(spark))


@query(
    rf"""{C.SEG}, f AS (SELECT chapter_id, segment_id, segment_order, coalesce(regexp_matches(trim(source_text), '^(?:["''“‘—]|- )|["”]$') OR regexp_matches(lower(trim(source_text)), '^(?:he said|she said|said )'), false) AS dialogue FROM segments),
    c AS (SELECT *, CASE WHEN dialogue AND lag(dialogue) OVER (PARTITION BY chapter_id ORDER BY segment_order) THEN 0 ELSE 1 END AS new FROM f)
    SELECT segment_id, dialogue, (sum(new) OVER (PARTITION BY chapter_id ORDER BY segment_order))::BIGINT AS run FROM c"""
)
def chapter_dialogue_runs(spark, sf):
    w = Window.partitionBy("chapter_id").orderBy("segment_order")
    f = R.segments(spark, sf).select("chapter_id", "segment_id", "segment_order", T.is_dialogue(F.col("source_text")).alias("dialogue"))
    c = f.withColumn("new", F.when(F.col("dialogue") & F.lag("dialogue").over(w), 0).otherwise(1))
    return c.select("segment_id", "dialogue", F.sum("new").over(w).alias("run"))


def _library(spark, sf):
    """Books ingested in two halves, one of them twice, and every fifth book again with other texts. Beside them lies
    what a run has left that was stopped before its end."""
    s = R.segments(spark, sf).select("segment_id", "chapter_id", "book_id", "segment_order", "source_text")
    path = f"{scratch.folder(spark)}/{uuid.uuid4().hex}/library"
    for half in (0, 1, 0):
        library.ingest(s.where(F.col("book_id") % 2 == half), path)
    library.write(s.where("book_id % 3 = 0").withColumn("source_text", F.lit("stopped")), path)
    library.ingest(s.where("book_id % 5 = 0").withColumn("source_text", F.concat(F.lit("* "), "source_text")), path)
    return path


@query(f"""{C.SEG}, l AS (SELECT book_id, chapter_id, segment_id, CASE WHEN book_id % 5 = 0 THEN '* ' || source_text ELSE source_text END AS source_text FROM segments WHERE book_id IS NOT NULL)
    SELECT book_id, count(DISTINCT chapter_id) AS chapters, count(*) AS segments, sum(length(source_text))::BIGINT AS chars, min(sha256(source_text)) AS least FROM l GROUP BY book_id""")
def ingested_library(spark, sf):
    path = _library(spark, sf)
    s = library.table(spark, path, "segments").groupBy("book_id").agg(F.sum(F.length("source_text")).alias("chars"), F.min(F.sha2("source_text", 256)).alias("least"))
    return library.table(spark, path, "books").join(s, "book_id").select("book_id", "chapters", "segments", "chars", "least")


# -- long paragraphs -----------------------------------------------------------------------------------

_N = R.NORM
_CUTS = {1: f"regexp_replace(t, '{P.SENTENCE_END.replace(chr(39), chr(39) * 2)}', '\\1' || chr(31), 'g')", 2: f"regexp_replace(t, '{P.CLAUSE_END}', '\\1' || chr(31), 'g')", 3: r"regexp_replace(raw, '[\n\x0B\f\r\x{85}\x{2028}\x{2029}]+', chr(31), 'g')", 4: "replace(t, ' ', chr(31))"}
_PARTS = f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS raw, {_N.format(x="text")} AS t FROM documents),
  un AS ({" UNION ALL ".join(f"SELECT doc_id, t, {k} AS k, list_filter(list_transform(string_split({cut}, chr(31)), lambda x: {_N.format(x='x')}), lambda x: x <> '') AS us FROM d WHERE length(t) > 1800" for k, cut in _CUTS.items())}),
  ok AS (SELECT * FROM un WHERE len(us) > 1 AND array_to_string(us, ' ') = t AND list_max(list_transform(us, lambda x: length(x))) <= 1800),
  ui AS (SELECT doc_id, k, unnest(us) AS u, unnest(range(len(us))) AS i FROM ok),
  f AS (SELECT doc_id, k, i, 0 AS p, length(u) AS z FROM ui WHERE i = 0
    UNION ALL SELECT ui.doc_id, ui.k, ui.i, CASE WHEN z + 1 + length(u) > 1800 THEN p + 1 ELSE p END, CASE WHEN z + 1 + length(u) > 1800 THEN length(u) ELSE z + 1 + length(u) END FROM f JOIN ui ON ui.doc_id = f.doc_id AND ui.k = f.k AND ui.i = f.i + 1),
  ps AS (SELECT doc_id, k, p, string_agg(u, ' ' ORDER BY i) AS part FROM f JOIN ui USING (doc_id, k, i) GROUP BY doc_id, k, p),
  good AS (SELECT doc_id, k, count(*) AS n FROM (SELECT *, max(p) OVER (PARTITION BY doc_id, k) AS top FROM ps) GROUP BY doc_id, k HAVING count(*) > 1 AND (k < 4 OR coalesce(min(length(part)) FILTER (p < top), 900) >= 900)),
  pick AS (SELECT doc_id, min(k) AS k FROM good GROUP BY doc_id),
  parts AS (SELECT doc_id, p AS part_index, n AS part_count, part FROM ps JOIN pick USING (doc_id, k) JOIN good USING (doc_id, k)
    UNION ALL SELECT doc_id, 0, 1, t FROM d WHERE doc_id NOT IN (SELECT doc_id FROM pick))"""


def _parts(spark, sf):
    d = R.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw"), T.norm(F.col("text")).alias("t"))
    return P.split_long(d, "t", "raw").select("doc_id", "t", "parts")


@query(f"{_PARTS} SELECT doc_id, part_index::INT AS part_index, part_count::INT AS part_count, part FROM parts")
def paragraph_parts(spark, sf):
    return _parts(spark, sf).select("doc_id", F.posexplode_outer("parts").alias("part_index", "part"), F.size("parts").alias("part_count")).select("doc_id", "part_index", "part_count", "part")


@query(f"{_PARTS} SELECT d.doc_id, count(*) AS n_parts, string_agg(part, ' ' ORDER BY part_index) = any_value(t) AND count(*) = max(part_count) AS whole, max(length(part))::INT AS longest FROM d JOIN parts USING (doc_id) GROUP BY d.doc_id")
def paragraph_rejoin(spark, sf):
    """Whether parts in order, joined by a space, are the paragraph again, and the longest part: over the limit only
    where words are too long to cut."""
    p = _parts(spark, sf)
    each = p.select("doc_id", F.posexplode_outer("parts").alias("i", "part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "part"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda v: v["part"]), " ")
    longest = F.array_max(F.transform("x", lambda v: F.length(v["part"])))
    return p.select("doc_id", "t").join(each, "doc_id").select("doc_id", F.size("x").cast("long").alias("n_parts"), (joined == F.col("t")).alias("whole"), longest.alias("longest"))


# -- answers of providers --------------------------------------------------------------------------------


def _answers(spark, sf):
    """Turns of conversations as answers of providers in eight shapes: each path, with what is no string before it, and none."""
    t, case = F.col("text"), (F.col("conv_id") + F.col("turn")) % 8
    js = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    message = F.array(F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices")
    listed = F.array(F.struct(F.struct(F.array(F.lit(1)).alias("content")).alias("message"))).alias("choices")
    part = lambda x, y: F.struct(x.alias("text"), y.alias("type"))
    none = F.lit(None).cast("string")
    of = lambda *p: F.array(F.struct(F.array(*p).alias("content"))).alias("output")
    body = (
        F.when(case == 0, js(t.alias("output_text"))).when(case == 1, js(F.lit(5).alias("output_text"), message)).when(case == 2, js(listed, of(part(none, F.lit("x")), part(t, F.lit("y")))))
        .when(case == 3, F.regexp_replace(js(of(part(t, none), part(F.lit("late"), none))), r"^\{.output.:\[", '{"output":[{"id":1},{"content":"no"},')).when(case == 4, js(F.array().cast("array<string>").alias("choices")))
        .when(case == 5, F.substring(js(t.alias("output_text")), 1, 20)).when(case == 6, js(none.alias("output_text"), message)).otherwise(F.concat(F.lit("["), js(t.alias("output_text")), F.lit("]")))
    )
    return R.table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body"))


_ANSWERS = """a AS (SELECT conv_id, turn, text, (conv_id + turn) % 8 AS k, to_json(text)::VARCHAR AS j FROM conversations),
  b AS (SELECT conv_id, turn, CASE k WHEN 0 THEN '{"output_text":' || j || '}' WHEN 1 THEN '{"output_text":5,"choices":[{"message":{"content":' || j || '}}]}' WHEN 2 THEN '{"choices":[{"message":{"content":[1]}}],"output":[{"content":[{"text":null,"type":"x"},{"text":' || j || '}]}]}'
    WHEN 3 THEN '{"output":[{"id":1},{"content":"no"},{"content":[{"text":' || j || '},{"text":"late"}]}]}' WHEN 4 THEN '{"choices":[]}' WHEN 5 THEN substr('{"output_text":' || j || '}', 1, 20) WHEN 6 THEN '{"output_text":null,"choices":[{"message":{"content":' || j || '}}]}' ELSE '[{"output_text":' || j || '}]' END AS body FROM a),
  v AS (SELECT conv_id, turn, CASE WHEN json_valid(body) THEN body::JSON END AS d FROM b)"""


@query(f"""WITH {_ANSWERS}, x AS (SELECT conv_id, turn, CASE WHEN json_type(d, '$.output_text') = 'VARCHAR' THEN d->>'$.output_text' WHEN json_type(d, '$.choices[0].message.content') = 'VARCHAR' THEN d->>'$.choices[0].message.content'
    ELSE list_filter(json_extract(d, '$.output[*].content[*].text'), lambda y: json_type(y) = 'VARCHAR')[1]->>'$' END AS text FROM v)
    SELECT conv_id, turn, text, CASE WHEN text IS NULL THEN 'no output text' END AS fault FROM x""")
def output_texts(spark, sf):
    x = _answers(spark, sf).select("conv_id", "turn", T.output_text(F.col("body")).alias("text"))
    return x.withColumn("fault", F.when(F.col("text").isNull(), "no output text"))


# -- notes as a log of changes ----------------------------------------------------------------------------


def _changes(spark, sf):
    """Events as changes of 300 notes by five actors, of whom one is an admin."""
    e, way = R.table(spark, sf, "events"), F.floor(F.col("event_id") / 7) * 7919 % 10
    op = F.when(way < 3, "create").when(way < 9, "update").otherwise("delete")
    actor = F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))
    return e.select((F.col("event_id") % 300).alias("note_id"), F.col("event_id").alias("change_id"), F.col("ts").alias("at"), op.alias("op"), actor.alias("actor"), (F.col("user_id") % 5 == 0).alias("admin"), F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string")).alias("content"))


_CHANGES = """ch AS (SELECT event_id % 300 AS note_id, event_id AS id, ts, CASE WHEN (event_id // 7) * 7919 % 10 < 3 THEN 'create' WHEN (event_id // 7) * 7919 % 10 < 9 THEN 'update' ELSE 'delete' END AS op, 'u' || (user_id % 5) AS actor, user_id % 5 = 0 AS admin, event_type || ' ' || event_id AS content FROM events),
  q AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY ts, id) AS i FROM ch)"""


@query(
    f"""WITH RECURSIVE {_CHANGES}, st AS (SELECT note_id, 0::BIGINT AS i, NULL::VARCHAR AS creator, NULL::VARCHAR AS content, NULL::TIMESTAMP AS created_at, NULL::TIMESTAMP AS updated_at, false AS deleted, 0::BIGINT AS refused FROM q WHERE i = 1
      UNION ALL SELECT q.note_id, q.i, CASE WHEN creator IS NULL AND op = 'create' THEN actor ELSE creator END,
        CASE WHEN creator IS NULL AND op = 'create' OR creator IS NOT NULL AND NOT deleted AND op = 'update' AND (admin OR actor = creator) THEN q.content ELSE st.content END, CASE WHEN creator IS NULL AND op = 'create' THEN ts ELSE created_at END,
        CASE WHEN creator IS NULL AND op = 'create' OR creator IS NOT NULL AND NOT deleted AND op = 'update' AND (admin OR actor = creator) THEN ts ELSE updated_at END,
        deleted OR creator IS NOT NULL AND op = 'delete' AND (admin OR actor = creator),
        refused + (NOT (creator IS NULL AND op = 'create' OR creator IS NOT NULL AND NOT deleted AND op <> 'create' AND (admin OR actor = creator)))::INT
      FROM st JOIN q ON q.note_id = st.note_id AND q.i = st.i + 1)
    SELECT note_id, creator, content, created_at, updated_at, deleted, refused FROM st WHERE creator IS NOT NULL QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY i DESC) = 1"""
)
def notes_change_log(spark, sf):
    """Changes in three batches, each with some that are late, the first of them applied twice."""
    path, c = f"{scratch.folder(spark)}/{uuid.uuid4().hex}/notes", _changes(spark, sf)
    for batch in (0, 1, 0, 2):
        changes.apply(c.where(F.col("change_id") % 3 == batch), path)
    return changes.notes(spark, path, deleted=True)
