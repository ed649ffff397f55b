"""The engine's relations over the given tables, and the same as SQL for DuckDB.

A document is a chapter, its lines are segments, its source is a book; orders are jobs and artifacts,
line items are chunks, conversations are notes, events are dispatch messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

ZH = "这是一个固定的中文句子。"
GLOSSARY = [("there", "那里", "word"), ("ther", "", "word"), (" The ", "该", None), ("Ing", "英", "name"), ("and", None, "word")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment_id, chapter_id, book_id, segment_order, source_text, segment_type, status, translated_text."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "FAILED").when(F.col("quality") == 0, "PENDING").otherwise("TRANSLATED")
    d = d.select("doc_id", F.substring("source", 4, 10).cast("int").alias("book_id"), status.alias("status"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    s = d.select("doc_id", "book_id", "status", (F.col("pos") + 1).cast("long").alias("segment_order"), T.norm(F.col("line")).alias("source_text")).where("source_text <> ''")
    s = s.withColumn("segment_id", F.col("doc_id") * 100000 + F.col("segment_order"))
    case = F.col("segment_id") % 5
    t = (
        F.when(F.col("status") != "TRANSLATED", None)
        .when(case == 0, F.concat(F.lit("[zh] "), "source_text"))
        .when(case == 1, "译文")
        .when(case == 2, F.repeat(F.lit("译文内容"), F.length("source_text")))
        .when(case == 3, F.lower(F.substring("source_text", 1, 40)))
        .otherwise(ZH)
    )
    return s.select("segment_id", F.col("doc_id").alias("chapter_id"), "book_id", "segment_order", "source_text", F.lit("PARAGRAPH").alias("segment_type"), "status", t.alias("translated_text"))


NORM = r"regexp_replace(regexp_replace(coalesce({x}, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '\s+', ' ', 'g')"

SEGMENTS = rf"""
labs AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
lin AS (SELECT d.doc_id, CAST(substr(source, 4, 10) AS INT) AS book_id, CASE WHEN toxic = 1 THEN 'FAILED' WHEN quality = 0 THEN 'PENDING' ELSE 'TRANSLATED' END AS status,
  string_split(text, chr(10)) AS ls FROM documents d LEFT JOIN labs USING (doc_id)),
pos AS (SELECT doc_id, book_id, status, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS segment_order FROM lin),
nrm AS (SELECT *, {NORM.format(x="line")} AS source_text, doc_id * 100000 + segment_order AS segment_id FROM pos),
segments AS (SELECT segment_id, doc_id AS chapter_id, book_id, segment_order, source_text, 'PARAGRAPH' AS segment_type, status,
  CASE WHEN status <> 'TRANSLATED' THEN NULL WHEN segment_id % 5 = 0 THEN '[zh] ' || source_text WHEN segment_id % 5 = 1 THEN '译文'
    WHEN segment_id % 5 = 2 THEN repeat('译文内容', length(source_text)) WHEN segment_id % 5 = 3 THEN lower(substr(source_text, 1, 40)) ELSE '{ZH}' END AS translated_text
  FROM nrm WHERE source_text <> '')
"""


def glossary(spark: SparkSession, rows: list[tuple] = GLOSSARY) -> DataFrame:
    return spark.createDataFrame(rows, "source_term string, target_term string, category string")


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


GLOSSARY_SQL = f"glossary(source_term, target_term, category) AS (VALUES {_values(GLOSSARY)})"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderpriority") == "5-LOW", "FAILED").when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderkey") % 3 == 0), "CANCELED").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("book_id"), F.col("o_orderdate").alias("updated_at"), status.alias("status"))


JOBS = "jobs AS (SELECT o_orderkey AS job_id, o_custkey AS book_id, o_orderdate AS updated_at, CASE WHEN o_orderpriority = '5-LOW' THEN 'FAILED' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0 THEN 'CANCELED' WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status FROM orders)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")).otherwise(F.when(F.col("l_returnflag") == "N", "RUNNING").otherwise("PENDING"))
    locked = F.when(F.col("l_quantity") > 10, F.col("l_shipdate"))
    return x.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("line"), status.alias("status"), (F.col("l_linenumber") % 4).alias("attempt_count"), locked.alias("locked_until"))


CHUNKS = "chunks AS (SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS line, CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END WHEN l_returnflag = 'N' THEN 'RUNNING' ELSE 'PENDING' END AS status, l_linenumber % 4 AS attempt_count, CASE WHEN l_quantity > 10 THEN l_shipdate END AS locked_until FROM lineitem)"


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("book_id"), (F.col("o_orderkey") % 4).alias("kind"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("PENDING").alias("status"), F.col("o_orderdate").alias("created_at"))


ARTIFACTS = "artifacts AS (SELECT o_orderkey AS artifact_id, o_custkey AS book_id, o_orderkey % 4 AS kind, CASE WHEN o_orderstatus = 'F' THEN 'READY' ELSE 'PENDING' END AS status, o_orderdate AS created_at FROM orders)"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations on the first segment of a chapter; three chapters one after another have one title."""
    c = table(spark, sf_dir, "conversations").withColumn("note_id", F.col("conv_id") * 1000 + F.col("turn"))
    made = F.date_add(F.lit("1998-09-02").cast("date"), (F.col("note_id") % 28).cast("int")).cast("timestamp_ntz")
    return c.select("note_id", (F.col("conv_id") * 100000 + 1).alias("segment_id"), F.col("text").alias("note_content"), F.col("role").alias("created_by"), made.alias("created_at"))


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with their segments, chapters and books."""
    title = F.concat(F.lit("Chapter "), F.floor(F.col("chapter_id") / 3).cast("string"))
    j = notes(spark, sf_dir).join(segments(spark, sf_dir), "segment_id")
    return j.withColumns({"chapter_order": F.col("chapter_id"), "chapter_title": title, "book_title": F.concat(F.lit("Book "), F.col("book_id").cast("string"))})


NOTES = """notes AS (SELECT conv_id * 1000 + turn AS note_id, conv_id * 100000 + 1 AS segment_id, text AS note_content, role AS created_by, (DATE '1998-09-02' + ((conv_id * 1000 + turn) % 28)::INT)::TIMESTAMP AS created_at FROM conversations),
  noted AS (SELECT n.*, s.* EXCLUDE (segment_id), 'Chapter ' || (chapter_id // 3) AS chapter_title, 'Book ' || book_id AS book_title FROM notes n JOIN segments s USING (segment_id)),
  headed AS (SELECT *, row_number() OVER w AS i, row_number() OVER w = 1 OR chapter_title IS DISTINCT FROM lag(chapter_title) OVER w AS new_heading FROM noted WINDOW w AS (PARTITION BY book_id ORDER BY chapter_id, segment_order, created_at, note_id))"""
