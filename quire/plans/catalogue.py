"""The engine's own queries over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import glossary as G
from quire.operators import planning, progress, quality
from quire.plans import relations as R
from quire.sources import epub
from quire.sources.scratch import stage
from quire.streaming import dispatch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEG, JOBS, CHUNKS = f"WITH {R.SEGMENTS}", f"WITH {R.JOBS}", f"WITH {R.CHUNKS}"
NOW = "1998-09-02"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- scans and filters -------------------------------------------------------------------------------


@query(f"{SEG} SELECT segment_id, chapter_id, book_id, segment_order, source_text, status FROM segments")
def scan_segments(spark, sf):
    return R.segments(spark, sf).select("segment_id", "chapter_id", "book_id", "segment_order", "source_text", "status")


FRAGMENTS = ["2048", "www.example.org", "..", "…", "—", "7)", "The tide turned.", "b2", "", "https://x.y/z", "½", "Ⅳ", "²³", "①②③④", "½ a", "x½"]


@query(
    rf"""{SEG}, texts AS (SELECT source_text AS t FROM segments UNION ALL SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in FRAGMENTS)})),
    b AS (SELECT t, regexp_replace(t, '\s+', '', 'g') AS x FROM texts)
    SELECT t AS kept_text FROM b WHERE NOT (x = '' OR regexp_matches(x, '(?i)^(https?://|www\.).+') OR regexp_matches(x, '^[\p{{P}}\p{{S}}]+$') OR regexp_matches(x, '^\p{{N}}+$') OR (length(x) <= 3 AND regexp_matches(x, '^[\p{{N}}\p{{P}}\p{{S}}]+$')))"""
)
def nontranslatable_filter(spark, sf):
    extra = spark.createDataFrame([(x,) for x in FRAGMENTS], "t string")
    t = R.segments(spark, sf).select(F.col("source_text").alias("t")).unionByName(extra)
    return t.where(~T.non_translatable(F.col("t"))).select(F.col("t").alias("kept_text"))


@query(f"{SEG} SELECT segment_id, sha256(source_text) AS digest FROM segments")
def segment_digest(spark, sf):
    return R.segments(spark, sf).select("segment_id", F.sha2("source_text", 256).alias("digest"))


# -- progress ----------------------------------------------------------------------------------------

COUNTS = "count(*) AS total, count_if(status = 'TRANSLATED')::BIGINT AS translated, count_if(status = 'FAILED')::BIGINT AS failed"


@query(f"{SEG} SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE (translated + failed) / total END AS progress FROM (SELECT book_id, {COUNTS} FROM segments GROUP BY book_id)")
def book_progress(spark, sf):
    return progress.book_progress(R.segments(spark, sf))


@query(f"{SEG} SELECT d.doc_id AS chapter_id, coalesce(total, 0) AS total, coalesce(translated, 0) AS translated, coalesce(failed, 0) AS failed FROM documents d LEFT JOIN (SELECT chapter_id, {COUNTS} FROM segments GROUP BY chapter_id) g ON d.doc_id = g.chapter_id")
def chapter_progress(spark, sf):
    chapters = R.table(spark, sf, "documents").select(F.col("doc_id").alias("chapter_id"))
    return progress.chapter_progress(chapters, R.segments(spark, sf))


@query(f"{SEG} SELECT chapter_id, total, translated, translated / total AS progress FROM (SELECT chapter_id, {COUNTS} FROM segments GROUP BY chapter_id)")
def reader_chapter_summary(spark, sf):
    g = progress.chapter_counts(R.segments(spark, sf))
    return g.select("chapter_id", "total", "translated", progress.ratio(F.col("translated"), F.col("total")).alias("progress"))


LATEST_JOB = "latest AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY updated_at DESC, job_id DESC) = 1)"


def _latest(spark, sf):
    return progress.latest(R.jobs(spark, sf), ["book_id"], F.desc("updated_at"), F.desc("job_id"))


@query(f"{JOBS}, {LATEST_JOB} SELECT book_id, job_id, status FROM latest")
def latest_job_per_book(spark, sf):
    return _latest(spark, sf).select("book_id", "job_id", "status")


STATE = "CASE status WHEN 'RUNNING' THEN 'running' WHEN 'COMPLETED' THEN 'completed' WHEN 'FAILED' THEN 'failed' WHEN 'CANCELED' THEN 'failed' ELSE 'pending' END"


@query(f"{JOBS}, {LATEST_JOB} SELECT count(*) AS total, count_if(s = 'running')::BIGINT AS running, count_if(s = 'completed')::BIGINT AS completed, count_if(s = 'failed')::BIGINT AS failed FROM (SELECT {STATE} AS s FROM latest)")
def library_status_counts(spark, sf):
    s = _latest(spark, sf).select(progress.dashboard_status(F.col("status"), F.lit("PARSED")).alias("s"))
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("s") == x).alias(x) for x in ("running", "completed", "failed")])


@query(
    f"""{SEG}, {R.JOBS}, {LATEST_JOB}, b AS (SELECT book_id, {COUNTS} FROM segments GROUP BY book_id)
    SELECT b.book_id, total, translated, {STATE} AS status, CASE WHEN latest.status = 'COMPLETED' THEN 1.0::DOUBLE ELSE translated / total END AS progress FROM b LEFT JOIN latest USING (book_id)"""
)
def library_totals(spark, sf):
    b = progress.book_progress(R.segments(spark, sf)).select("book_id", "total", "translated")
    j = _latest(spark, sf).select("book_id", F.col("status").alias("job"))
    done = F.when(F.col("job") == "COMPLETED", 1.0).otherwise(F.col("translated") / F.col("total"))
    return b.join(j, "book_id", "left").select("book_id", "total", "translated", progress.dashboard_status(F.col("job"), F.lit("PARSED")).alias("status"), done.alias("progress"))


@query(
    f"""{JOBS}, {R.CHUNKS}, g AS (SELECT job_id, count(*) AS n, count_if(status IN ('COMPLETED', 'SUPERSEDED')) AS done, count_if(status = 'FAILED' AND attempt_count >= 3) AS exhausted FROM chunks GROUP BY job_id)
    SELECT job_id, status AS old_status, CASE WHEN status = 'CANCELED' OR coalesce(n, 0) = 0 THEN status WHEN done = n THEN 'COMPLETED' WHEN exhausted > 0 THEN 'FAILED' ELSE status END AS status,
      coalesce(n, 0)::BIGINT AS n, coalesce(done, 0)::BIGINT AS done, coalesce(exhausted, 0)::BIGINT AS exhausted FROM jobs LEFT JOIN g USING (job_id)"""
)
def job_rollup(spark, sf):
    return progress.job_rollup(R.jobs(spark, sf), R.chunks(spark, sf))


@query(f"WITH {R.ARTIFACTS} SELECT book_id, kind, artifact_id, status FROM artifacts QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY created_at DESC NULLS LAST, artifact_id DESC) = 1")
def latest_artifact_per_kind(spark, sf):
    return progress.latest(R.artifacts(spark, sf), ["book_id", "kind"], F.desc_nulls_last("created_at"), F.desc("artifact_id")).select("book_id", "kind", "artifact_id", "status")


@query(f"WITH {R.ARTIFACTS} SELECT book_id, kind, artifact_id FROM artifacts WHERE status = 'READY' QUALIFY row_number() OVER (PARTITION BY book_id, kind ORDER BY created_at DESC NULLS LAST, artifact_id DESC) = 1")
def ready_artifact_gate(spark, sf):
    ready = R.artifacts(spark, sf).where("status = 'READY'")
    return progress.latest(ready, ["book_id", "kind"], F.desc_nulls_last("created_at"), F.desc("artifact_id")).select("book_id", "kind", "artifact_id")


@query("SELECT c_custkey AS book_id, c_nationkey AS owner_user_id FROM customer WHERE c_nationkey = 7")
def accessible_books(spark, sf):
    books = R.table(spark, sf, "customer").select(F.col("c_custkey").alias("book_id"), F.col("c_nationkey").alias("owner_user_id"))
    return progress.accessible(books, 7)


_ROLES = """users AS (SELECT c_custkey AS user_id FROM customer WHERE c_nationkey < 20),
  roles AS (SELECT c_custkey AS user_id, c_mktsegment AS role FROM customer UNION ALL SELECT c_custkey, 'ADMIN' FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT c_custkey, 'GUEST' FROM customer WHERE c_nationkey >= 20)"""


@query(f"WITH {_ROLES} SELECT role, count(u.user_id) AS n_users, count(u.user_id) > 0 AS has_any FROM roles LEFT JOIN users u USING (user_id) GROUP BY role")
def users_by_role(spark, sf):
    """Of each role, how many users there are; a user has several, and some roles are left of users that are gone."""
    c = R.table(spark, sf, "customer").withColumn("user_id", F.col("c_custkey"))
    users = c.where("c_nationkey < 20").select("user_id", F.lit(1).alias("there"))
    roles = c.select("user_id", F.col("c_mktsegment").alias("role"))
    for role, those in (("ADMIN", "c_acctbal > 9000"), ("GUEST", "c_nationkey >= 20")):
        roles = roles.unionByName(c.where(those).select("user_id", F.lit(role).alias("role")))
    n = F.count("there")
    return roles.join(users, "user_id", "left").groupBy("role").agg(n.alias("n_users"), (n > 0).alias("has_any"))


@query(f"{JOBS}, {R.CHUNKS} SELECT job_id, book_id FROM jobs j WHERE status = 'CANCELED' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.job_id = j.job_id AND c.status = 'RUNNING')")
def orphan_sessions(spark, sf):
    running = R.chunks(spark, sf).where("status = 'RUNNING'").select("job_id")
    return R.jobs(spark, sf).where("status = 'CANCELED'").select("job_id", "book_id").join(running, "job_id", "left_anti")


@query(f"{CHUNKS} SELECT job_id, count(*) AS n FROM chunks WHERE status = 'RUNNING' AND locked_until < TIMESTAMP '{NOW}' GROUP BY job_id")
def expired_leases(spark, sf):
    return progress.expired(R.chunks(spark, sf), F.lit(NOW).cast("timestamp_ntz")).groupBy("job_id").agg(F.count("*").alias("n"))


@query(f"{CHUNKS} SELECT job_id, count(*) AS n FROM chunks WHERE attempt_count < 3 AND (status IN ('PENDING', 'FAILED') OR (status = 'RUNNING' AND (locked_until IS NULL OR locked_until < TIMESTAMP '{NOW}'))) GROUP BY job_id")
def lease_eligible(spark, sf):
    return progress.lease_eligible(R.chunks(spark, sf), F.lit(NOW).cast("timestamp_ntz")).groupBy("job_id").agg(F.count("*").alias("n"))


# -- notes -------------------------------------------------------------------------------------------


@query(f"{SEG}, {R.NOTES} SELECT note_id, segment_id, chapter_id, note_content, new_heading FROM headed")
def notes_export_rows(spark, sf):
    return quality.with_headings(R.noted(spark, sf)).select("note_id", "segment_id", "chapter_id", "note_content", "new_heading")


@query(f"{SEG}, {R.NOTES}, g AS (SELECT segment_id, count(*) AS n FROM notes GROUP BY segment_id) SELECT segment_id, coalesce(n, 0)::BIGINT AS n_notes FROM segments LEFT JOIN g USING (segment_id)")
def note_counts(spark, sf):
    g = R.notes(spark, sf).groupBy("segment_id").agg(F.count("*").alias("n"))
    return R.segments(spark, sf).select("segment_id").join(g, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_notes"))


@query(f"{SEG} SELECT chapter_id, segment_id, ((row_number() OVER (PARTITION BY chapter_id ORDER BY segment_order) - 1) // 6 + 1)::BIGINT AS page FROM segments")
def reader_pages(spark, sf):
    w = Window.partitionBy("chapter_id").orderBy("segment_order")
    return R.segments(spark, sf).select("chapter_id", "segment_id", (F.floor((F.row_number().over(w) - 1) / 6) + 1).cast("long").alias("page"))


@query(f"""{SEG}, p AS (SELECT chapter_id, segment_id, ((row_number() OVER (PARTITION BY chapter_id ORDER BY segment_order) - 1) // 6 + 1)::BIGINT AS page, (count(*) OVER (PARTITION BY chapter_id) + 5) // 6 AS pages FROM segments)
    SELECT chapter_id, page, segment_id FROM p WHERE page = greatest(1, least(chapter_id % 9 - 2, pages))""")
def reader_page(spark, sf):
    """The rows of the page that is asked for, or the nearest there is."""
    return progress.page_of(R.segments(spark, sf), F.col("chapter_id") % 9 - 2).select("chapter_id", "page", "segment_id")


# -- planning ----------------------------------------------------------------------------------------


@query(f"{SEG}, done AS (SELECT * FROM segments WHERE status = 'TRANSLATED' AND trim(translated_text) <> '') SELECT segment_id, coalesce(list(segment_id) OVER (PARTITION BY chapter_id ORDER BY segment_order ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS context FROM done")
def context_window(spark, sf):
    return planning.context_window(R.segments(spark, sf))


PLAN = f"""WITH RECURSIVE {R.SEGMENTS},
  s AS (SELECT chapter_id, segment_id, length(source_text) AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY segment_order) AS i FROM segments),
  f AS (SELECT chapter_id, segment_id, n, i, 0::BIGINT AS chunk, 1 AS c, n AS chars FROM s WHERE i = 1
    UNION ALL SELECT s.chapter_id, s.segment_id, s.n, s.i, CASE WHEN c + 1 > 40 OR chars + s.n > 6000 THEN chunk + 1 ELSE chunk END,
      CASE WHEN c + 1 > 40 OR chars + s.n > 6000 THEN 1 ELSE c + 1 END, CASE WHEN c + 1 > 40 OR chars + s.n > 6000 THEN s.n ELSE chars + s.n END
    FROM f JOIN s ON s.chapter_id = f.chapter_id AND s.i = f.i + 1),
  plan AS (SELECT chapter_id, chunk, count(*) AS n_segments, sum(n)::BIGINT AS chars, list(segment_id ORDER BY i) AS segment_ids FROM f GROUP BY chapter_id, chunk)"""


@query(f"{PLAN} SELECT * FROM plan")
def chunk_plan(spark, sf):
    return planning.chunk_plan(R.segments(spark, sf))


@query(f"{PLAN} SELECT book_id, sum(n_segments)::BIGINT AS segments, count(*) AS chunks, (count(*) * 6)::BIGINT AS seconds FROM plan JOIN (SELECT doc_id AS chapter_id, CAST(substr(source, 4, 10) AS INT) AS book_id FROM documents) USING (chapter_id) GROUP BY book_id")
def preflight_estimate(spark, sf):
    books = R.table(spark, sf, "documents").select(F.col("doc_id").alias("chapter_id"), F.substring("source", 4, 10).cast("int").alias("book_id"))
    p = planning.chunk_plan(R.segments(spark, sf)).join(books, "chapter_id")
    return p.groupBy("book_id").agg(F.sum("n_segments").alias("segments"), F.count("*").alias("chunks"), (F.count("*") * 6).alias("seconds"))


@query(
    f"""{PLAN}, h AS (SELECT *, ceil(len(segment_ids) / 2)::INT AS half FROM plan WHERE len(segment_ids) > 1), x AS (SELECT *, unnest([0, 1]) AS i FROM h)
    SELECT chapter_id, chunk AS parent, (chunk * 1000 + i)::BIGINT AS child_order, 1 AS depth, floor(chars / 2)::BIGINT AS chars, CASE WHEN i = 0 THEN segment_ids[1:half] ELSE segment_ids[half + 1:] END AS segment_ids FROM x"""
)
def degrade_split(spark, sf):
    return planning.split_chunks(planning.chunk_plan(R.segments(spark, sf)).withColumn("depth", F.lit(0)))


# -- cache and providers -----------------------------------------------------------------------------

KEY = "sha256(concat_ws('|', sha256(source_text), 'en', 'zh', 'mock', 'mock-1', 'v1'))"
CACHE = f"{SEG}, keyed AS (SELECT segment_id, book_id, {KEY} AS cache_key FROM segments), cache AS (SELECT DISTINCT cache_key FROM keyed WHERE book_id < 10)"


def _keyed(spark, sf):
    parts = [F.sha2("source_text", 256), *map(F.lit, ("en", "zh", "mock", "mock-1", "v1"))]
    return R.segments(spark, sf).select("segment_id", "book_id", T.cache_key(*parts).alias("cache_key"))


def _cache(spark, sf):
    return _keyed(spark, sf).where("book_id < 10").select("cache_key").distinct()


@query(f"{CACHE} SELECT segment_id, cache_key FROM keyed")
def cache_key(spark, sf):
    return _keyed(spark, sf).select("segment_id", "cache_key")


@query(f"{CACHE} SELECT segment_id, keyed.cache_key, cache.cache_key IS NOT NULL AS hit FROM keyed LEFT JOIN cache ON keyed.cache_key = cache.cache_key WHERE book_id >= 10")
def cache_hits(spark, sf):
    c = _cache(spark, sf).withColumn("hit", F.lit(True))
    return _keyed(spark, sf).where("book_id >= 10").join(c, "cache_key", "left").select("segment_id", "cache_key", F.coalesce("hit", F.lit(False)).alias("hit"))


@query(f"{CACHE} SELECT DISTINCT cache_key FROM keyed WHERE book_id >= 10 AND cache_key NOT IN (SELECT cache_key FROM cache)")
def cache_misses(spark, sf):
    return _keyed(spark, sf).where("book_id >= 10").select("cache_key").distinct().join(_cache(spark, sf), "cache_key", "left_anti")


@query(rf"{SEG} SELECT segment_id, CASE WHEN regexp_matches(source_text, '[\p{{L}}\p{{N}}]') THEN '[zh] ' || source_text ELSE source_text END AS translated FROM segments")
def mock_translate(spark, sf):
    s = R.segments(spark, sf)
    return s.select("segment_id", F.when(T.has_letter_or_digit(F.col("source_text")), F.concat(F.lit("[zh] "), "source_text")).otherwise(F.col("source_text")).alias("translated"))


@query(rf"{SEG}, r AS (SELECT segment_id, trim(regexp_replace(replace(translated_text, source_text, ''), '\s+', ' ', 'g')) AS t FROM segments WHERE status = 'TRANSLATED') SELECT segment_id, '[reviewed] ' || CASE WHEN t = '' THEN '已审校译文' ELSE t END AS reviewed FROM r")
def mock_review(spark, sf):
    r = R.segments(spark, sf).where("status = 'TRANSLATED'")
    t = F.trim(F.regexp_replace(F.replace(F.col("translated_text"), F.col("source_text"), F.lit("")), r"\s+", " "))
    return r.select("segment_id", F.concat(F.lit("[reviewed] "), F.when(t == "", "已审校译文").otherwise(t)).alias("reviewed"))


@query(rf"{SEG} SELECT DISTINCT segment_id, w AS term FROM (SELECT segment_id, unnest(regexp_split_to_array(source_text, '[^\p{{L}}\p{{N}}'']+')) AS w FROM segments) WHERE length(w) >= 4 AND regexp_matches(w, '^\p{{Lu}}')")
def mock_terms(spark, sf):
    s = R.segments(spark, sf).select("segment_id", F.explode_outer(T.mock_terms(F.col("source_text"))).alias("term"))
    return s.where("term is not null")


@query(
    f"""{SEG}, e AS (SELECT segment_id AS id FROM segments), a AS (SELECT CASE WHEN id % 7 = 0 THEN id + 500000000000 ELSE id END AS id, CASE WHEN id % 11 = 0 THEN '' ELSE 'x' END AS t FROM e WHERE id % 13 <> 0 UNION ALL SELECT id, 'x' FROM e WHERE id % 17 = 0),
    g AS (SELECT id, count(*) AS n, bool_or(t = '') AS blank FROM a GROUP BY id)
    SELECT coalesce(e.id, g.id) AS segment_id, CASE WHEN e.id IS NULL THEN 'unexpected' WHEN g.id IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'blank' END AS fault FROM e FULL JOIN g ON e.id = g.id WHERE e.id IS NULL OR g.id IS NULL OR n > 1 OR blank"""
)
def validator_violations(spark, sf):
    e = R.segments(spark, sf).select(F.col("segment_id").alias("id"))
    a = e.where("id % 13 <> 0").select(F.when(F.col("id") % 7 == 0, F.col("id") + 500000000000).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 11 == 0, "").otherwise("x").alias("t"))
    a = a.unionByName(e.where("id % 17 = 0").select("id", F.lit("x").alias("t")))
    g = a.groupBy(F.col("id").alias("got")).agg(F.count("*").alias("n"), F.bool_or(F.col("t") == "").alias("blank"))
    j = e.join(g, F.col("id") == F.col("got"), "full_outer").where("id is null or got is null or n > 1 or blank")
    fault = F.when(F.col("id").isNull(), "unexpected").when(F.col("got").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("blank")
    return j.select(F.coalesce("id", "got").alias("segment_id"), fault.alias("fault"))


# -- quality -----------------------------------------------------------------------------------------

DISPLAY = "regexp_replace(coalesce(translated_text, ''), '\\[id\\d+\\]', '', 'g')"
NORMED = f"{SEG}, q AS (SELECT *, {R.NORM.format(x=DISPLAY)} AS t FROM segments)"
RESIDUE = "(len(regexp_extract_all(t, '[A-Za-z]{4,}')) >= 3 OR coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z]{4,}'), lambda w: length(w))), 0) >= 24)"
RATIO = "(length(source_text) >= 30 AND (length(t) / length(source_text) < 0.15 OR length(t) / length(source_text) > 3.5))"
REPEATED = "(length(source_text) >= 20 AND contains(t, source_text))"
_EXTRACTS = " || ".join("regexp_extract_all(source_text, '{}')".format(p.replace("'", "''")) for p in T.PRESERVED.values())
MISSING = rf"list_filter(list_filter(list_transform({_EXTRACTS}, lambda y: regexp_replace(y, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda y: y <> ''), lambda y: NOT contains(translated_text, y))"
DONE = "status = 'TRANSLATED' AND t <> ''"


@query(f"{NORMED} SELECT segment_id FROM q WHERE {DONE} AND {RESIDUE}")
def english_residue(spark, sf):
    t = T.norm(T.strip_placeholders(F.col("translated_text")))
    return R.segments(spark, sf).where("status = 'TRANSLATED'").where((t != "") & T.english_residue(t)).select("segment_id")


@query(f"{NORMED} SELECT segment_id FROM q WHERE {DONE} AND {RATIO}")
def length_ratio(spark, sf):
    t = T.norm(T.strip_placeholders(F.col("translated_text")))
    return R.segments(spark, sf).where("status = 'TRANSLATED'").where((t != "") & T.suspicious_ratio(F.col("source_text"), t)).select("segment_id")


@query(f"{NORMED} SELECT segment_id FROM q WHERE {DONE} AND {REPEATED}")
def source_repeated(spark, sf):
    t = T.norm(T.strip_placeholders(F.col("translated_text")))
    return R.segments(spark, sf).where("status = 'TRANSLATED'").where((t != "") & T.source_repeated(F.col("source_text"), t)).select("segment_id")


@query(f"{SEG}, m AS (SELECT segment_id, list_sort(list_distinct({MISSING})) AS missing FROM segments WHERE status = 'TRANSLATED') SELECT segment_id, missing FROM m WHERE len(missing) > 0")
def missing_tokens(spark, sf):
    m = R.segments(spark, sf).where("status = 'TRANSLATED'").select("segment_id", F.array_sort(T.missing_tokens(F.col("source_text"), F.col("translated_text"))).alias("missing"))
    return m.where(F.size("missing") > 0)


MISSES = "SELECT segment_id, count(*) AS n_missed FROM segments, (SELECT DISTINCT trim(source_term) AS s, trim(target_term) AS g FROM glossary WHERE trim(source_term) <> '' AND trim(coalesce(target_term, '')) <> '') WHERE status = 'TRANSLATED' AND contains(lower(source_text), lower(s)) AND NOT contains(translated_text, g) GROUP BY segment_id"


@query(f"{SEG}, {R.GLOSSARY_SQL} {MISSES}")
def glossary_miss(spark, sf):
    return quality.glossary_misses(R.segments(spark, sf), R.glossary(spark))


SCORED = f"""{NORMED}, {R.GLOSSARY_SQL}, gm AS ({MISSES}), r AS (SELECT q.*, coalesce(n_missed, 0) AS m,
    {REPEATED} AS r1, {RESIDUE} AS r2, {RATIO} AS r3, coalesce(len({MISSING}), 0) > 0 AS r4 FROM q LEFT JOIN gm USING (segment_id)),
  scored AS (SELECT *, CASE WHEN NOT ({DONE}) THEN 0 ELSE greatest(0, 100 - 35 * r1::INT - 20 * r2::INT - 20 * r3::INT - 20 * r4::INT - 25 * m) END AS score,
    CASE WHEN status = 'FAILED' THEN ['segment_failed'] WHEN NOT ({DONE}) THEN ['missing_translation'] ELSE list_filter([CASE WHEN r1 THEN 'source_repeated_in_translation' END, CASE WHEN r2 THEN 'english_residue' END,
      CASE WHEN r3 THEN 'suspicious_length_ratio' END, CASE WHEN r4 THEN 'preserved_token_missing' END], lambda y: y IS NOT NULL) || list_transform(range(m), lambda y: 'glossary_term_missing') END AS reasons FROM r)"""


def _scored(spark, sf):
    return quality.reasons(R.segments(spark, sf), R.glossary(spark))


@query(f"{SCORED} SELECT segment_id, score::INT AS score, reasons FROM scored")
def segment_scores(spark, sf):
    return _scored(spark, sf).select("segment_id", "score", "reasons")


@query(f"{SCORED} SELECT book_id, floor(avg(score) + 0.5)::BIGINT AS quality_score, count(*) AS n_segments FROM scored GROUP BY book_id")
def book_quality_score(spark, sf):
    return quality.book_scores(_scored(spark, sf))


@query(f"{SCORED} SELECT book_id, segment_id, CASE WHEN length(source_text) <= 160 THEN source_text ELSE substr(source_text, 1, 157) || '...' END AS preview, unnest(range(len(reasons)))::INT AS position, unnest(reasons) AS code FROM scored")
def segment_warnings(spark, sf):
    return quality.warnings(_scored(spark, sf))


CANDIDATES = f"{SCORED}, c AS (SELECT *, len(list_filter(reasons, lambda y: y NOT IN ('segment_failed', 'missing_translation'))) AS n_warnings FROM scored WHERE {DONE}), cand AS (SELECT * FROM c WHERE (score < 100 OR n_warnings > 0) AND (score < 80 OR n_warnings > 0))"


@query(f"{CANDIDATES} SELECT segment_id, score::INT AS score, n_warnings FROM cand")
def review_candidates(spark, sf):
    return quality.review_candidates(_scored(spark, sf)).select("segment_id", "score", "n_warnings")


@query(f"{CANDIDATES} SELECT book_id, segment_id, score::INT AS score, n_warnings, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score, n_warnings DESC, segment_id)::INT AS rank FROM cand) WHERE rank <= 20")
def review_topk(spark, sf):
    return quality.review_top(quality.review_candidates(_scored(spark, sf))).select("book_id", "segment_id", "score", "n_warnings", "rank")


# -- glossary ----------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{x}'" for x in T.STOP_TERMS)
TERMS = rf"""{SEG}, w AS (SELECT book_id, segment_id, regexp_extract_all(source_text, '{T.TERM}') AS ts FROM segments), x AS (SELECT book_id, segment_id, regexp_replace(trim(unnest(ts)), '\s+', ' ', 'g') AS term, unnest(range(len(ts))) AS pos FROM w),
  u AS (SELECT * FROM x WHERE length(term) BETWEEN 4 AND 80 AND term NOT IN ({_STOP}) AND split_part(term, ' ', 1) NOT IN ({_STOP})),
  g AS (SELECT book_id, lower(term) AS source_norm, min(row(segment_id, pos, term)) AS f, count(*) AS evidence FROM u GROUP BY book_id, lower(term)),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f[1], f[2])::INT AS rank FROM g),
  terms AS (SELECT book_id, source_norm, f[3] AS term, CASE WHEN contains(f[3], ' ') THEN 'proper_noun_phrase' ELSE 'proper_noun' END AS category, evidence, f[1] AS first_segment_id, rank FROM k WHERE rank <= 12)"""


@query(f"{TERMS} SELECT * FROM terms")
def proper_noun_terms(spark, sf):
    return G.first_terms(R.segments(spark, sf), 12)


@query(f"{SEG}, {R.GLOSSARY_SQL} SELECT segment_id, list_sort(list(trim(source_term))) AS relevant FROM segments JOIN glossary ON contains(lower(source_text), lower(trim(source_term))) GROUP BY segment_id")
def glossary_relevant(spark, sf):
    terms = [t[0].strip() for t in R.GLOSSARY]
    s = R.segments(spark, sf).withColumn("low", F.lower("source_text"))
    hits = F.array_sort(F.array_compact(F.array(*[F.when(F.col("low").contains(t.lower()), t) for t in terms])))
    return s.select("segment_id", hits.alias("relevant")).where(F.size("relevant") > 0)


#: Glossaries of the books' own terms: those of even books are there, those of odd ones come in; a term of several books has several
#: rows, some without a term, target or category.
MERGE = f"""{TERMS}, gl AS (SELECT book_id, (book_id * 100 + rank)::BIGINT AS pos, CASE WHEN rank % 7 = 0 THEN ' ' ELSE ' ' || term END AS s, CASE WHEN rank % 3 = 0 THEN '' ELSE 't' || book_id % 3 END AS t, CASE WHEN rank % 4 = 0 THEN NULL ELSE category END AS c FROM terms),
  cl AS (SELECT book_id, pos, lower(trim(s)) AS k, trim(s) AS s, nullif(trim(t), '') AS t, nullif(trim(c), '') AS c FROM gl WHERE trim(s) <> ''),
  a AS (SELECT * FROM cl WHERE book_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos) = 1), b AS (SELECT * FROM cl WHERE book_id % 2 = 1)"""
#: Row after row, as a merge goes: what a key holds when each row comes.
FILL = f"""{MERGE}, wm AS (SELECT b.*, a.k IS NULL AND row_number() OVER o = 1 AS added, coalesce(a.t, first_value(b.t IGNORE NULLS) OVER p) AS ht, coalesce(a.c, first_value(b.c IGNORE NULLS) OVER p) AS hc FROM b LEFT JOIN a ON a.k = b.k WINDOW o AS (PARTITION BY b.k ORDER BY b.pos), p AS (PARTITION BY b.k ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  inc AS (SELECT k, count_if(added) AS added, 0::BIGINT AS updated, count_if(NOT added AND (ht IS NULL AND t IS NOT NULL OR hc IS NULL AND c IS NOT NULL)) AS filled, count_if(coalesce(ht <> t, false)) AS conflicts, arg_min(s, pos) AS s, arg_min(t, pos) FILTER (t IS NOT NULL) AS t, arg_min(c, pos) FILTER (c IS NOT NULL) AS c FROM wm GROUP BY k),
  merged AS (SELECT coalesce(a.k, inc.k) AS source_norm, coalesce(a.s, inc.s) AS source_term, coalesce(a.t, inc.t) AS target_term, coalesce(a.c, inc.c) AS category, coalesce(added, 0)::BIGINT AS added, coalesce(updated, 0)::BIGINT AS updated, coalesce(filled, 0)::BIGINT AS filled, coalesce(conflicts, 0)::BIGINT AS conflicts FROM a FULL JOIN inc ON a.k = inc.k)"""
OVER = f"""{MERGE}, every AS (SELECT k, s, t, c, -1 AS pos FROM a UNION ALL SELECT k, s, t, c, pos FROM b), wm AS (SELECT *, lag(true) OVER o AS was, lag(s) OVER o AS ps, lag(t) OVER o AS pt, lag(c) OVER o AS pc FROM every WINDOW o AS (PARTITION BY k ORDER BY pos)),
  merged AS (SELECT k AS source_norm, arg_max(s, pos) AS source_term, max({{'p': pos, 'v': t}}).v AS target_term, max({{'p': pos, 'v': c}}).v AS category, count_if(was IS NULL AND pos >= 0) AS added, count_if(coalesce(was, false) AND (s IS DISTINCT FROM ps OR t IS DISTINCT FROM pt OR c IS DISTINCT FROM pc)) AS updated, 0::BIGINT AS filled, count_if(coalesce(was AND pt <> t, false)) AS conflicts FROM wm GROUP BY k)"""


def first_terms(spark, sf):
    """The first terms of each book, found once, whatever is asked of them."""
    return stage(G.first_terms(R.segments(spark, sf), 12), "terms")


def _glossaries(spark, sf):
    t = first_terms(spark, sf)
    rank = F.col("rank")
    g = t.select(
        "book_id",
        (F.col("book_id") * 100 + rank).cast("long").alias("pos"),
        F.when(rank % 7 == 0, " ").otherwise(F.concat(F.lit(" "), "term")).alias("source_term"),
        F.when(rank % 3 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("book_id") % 3).cast("string"))).alias("target_term"),
        F.when(rank % 4 != 0, F.col("category")).alias("category"),
    )
    return g.where("book_id % 2 = 0"), g.where("book_id % 2 = 1")


@query(f"{FILL} SELECT * FROM merged")
def glossary_merge_fill(spark, sf):
    return G.merge(*_glossaries(spark, sf))


@query(f"{OVER} SELECT * FROM merged")
def glossary_merge_overwrite(spark, sf):
    return G.merge(*_glossaries(spark, sf), "OVERWRITE")


@query(f"{MERGE} SELECT b.k AS source_norm, b.s AS source_term, b.t AS target_term, a.t AS configured_target FROM b JOIN a ON a.k = b.k WHERE a.t <> b.t")
def glossary_conflicts(spark, sf):
    there, come = _glossaries(spark, sf)
    return G.conflicts(come, there)


@query(f"{TERMS}, a AS (SELECT book_id, source_norm, 'x' AS target_term, evidence, first_segment_id FROM terms WHERE rank % 2 = 0), b AS (SELECT book_id, source_norm, NULL::VARCHAR AS target_term, evidence, first_segment_id FROM terms WHERE rank % 3 = 0) SELECT coalesce(a.book_id, b.book_id) AS book_id, coalesce(a.source_norm, b.source_norm) AS source_norm, coalesce(a.target_term, b.target_term) AS target_term, (coalesce(a.evidence, 0) + coalesce(b.evidence, 0))::BIGINT AS evidence, coalesce(a.first_segment_id, b.first_segment_id) AS first_segment_id FROM a FULL JOIN b ON a.book_id = b.book_id AND a.source_norm = b.source_norm")
def candidate_upsert(spark, sf):
    t = first_terms(spark, sf)
    cols = ["book_id", "source_norm", "target_term", "evidence", "first_segment_id"]
    return G.upsert(t.where("rank % 2 = 0").withColumn("target_term", F.lit("x")).select(cols), t.where("rank % 3 = 0").withColumn("target_term", F.lit(None).cast("string")).select(cols))


@query(
    f"""{SEG}, p AS (SELECT chapter_id, segment_order, source_text, row_number() OVER (PARTITION BY chapter_id ORDER BY segment_order) AS i, count(*) OVER (PARTITION BY chapter_id) AS n FROM segments)
    SELECT chapter_id, string_agg(source_text, ' ' ORDER BY segment_order) AS joined, bool_and(i = segment_order) AS complete FROM p GROUP BY chapter_id"""
)
def ordered_rejoin(spark, sf):
    g = R.segments(spark, sf).groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("segment_order", "source_text"))).alias("x"))
    return g.select("chapter_id", F.array_join(F.transform("x", lambda p: p["source_text"]), " ").alias("joined"), (F.element_at("x", -1)["segment_order"] == F.size("x")).alias("complete"))


# -- books and dispatch ------------------------------------------------------------------------------


def _books(spark, sf):
    """Lines of documents as small books, one archive a document."""
    import io
    import zipfile

    def made(batches):
        from html import escape

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
                    z.writestr("OEBPS/b.opf", '<package><metadata><title>Book</title></metadata><manifest><item id="c" href="c.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="c"/></spine></package>')
                    body = "".join(f"<p>{escape(''.join(c for c in line if c >= ' '))}</p>" for line in (text.as_py() or "").split("\n"))
                    z.writestr("OEBPS/c.xhtml", f"<html><body>{body}</body></html>")
                yield (str(doc_id.as_py()), out.getvalue()), out.tell()

    return R.table(spark, sf, "documents").select("doc_id", "text").mapInArrow(lambda batches: epub.gathered(made(batches), epub.ARCHIVES), "path string, content binary")


@query()
def epub_rows(spark, sf):
    return epub.read_books(_books(spark, sf))


@query()
def epub_export(spark, sf):
    books = _books(spark, sf)
    s = epub.read_books(books).where("error is null").withColumn("translated_text", F.concat(F.lit("[zh] "), "source_text"))
    return epub.export_books(books, s).select("path", "size", "checksum")


@query()
def stream_lease_replay(spark, sf):
    e = R.table(spark, sf, "events")
    outcome = F.when(F.col("value") % 3 < 1, "failure").when(F.col("value") % 3 < 2, "crash").otherwise("success")
    return dispatch.dispatch(e.select(F.col("user_id").alias("chunk_id"), F.col("ts").alias("requested_at"), outcome.alias("outcome"), F.lit(2).alias("n_segments")))


from quire.plans import marked, workflow  # noqa: E402, F401  (add their queries)
