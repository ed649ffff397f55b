"""The queries of the llm operators over the whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, exact, lines, lm, mix, neardup, pages, periodic, pii, repeats, rules, tokens, whiten


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{decontam.SEPARATORS}'), lambda x: x <> '') AS ws
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}'), '{decontam.SEPARATORS}'), lambda x: x <> '') AS ws
  FROM benchmark
), wl AS (SELECT *, least(10, len(ws)) AS l FROM b WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, ws[i:i + l - 1] AS w FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS i FROM wl)),
pos AS (SELECT k, l, i, ws[i:i + l - 1] AS w FROM (SELECT k, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM wl) WHERE len(ws) >= l)),
hit AS (SELECT k, i, pos.l AS l, item_id FROM pos JOIN win ON pos.l = win.l AND pos.w = win.w),
n AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + l)) AS p FROM hit) GROUP BY k),
its AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN its USING (k)
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.schedule(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_taken")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap,
    sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w
  FROM s
), c AS (SELECT *, rest * w >= cap * rest_w AS capped FROM r),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((SELECT (max({'w': rest_w, 'r': rest}) FILTER (NOT capped)).r FROM c) * w)::DOUBLE / (SELECT (max({'w': rest_w, 'r': rest}) FILTER (NOT capped)).w FROM c)::DOUBLE END AS target
  FROM c
), q AS (
  SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, h, size, (e * source_size + cum)::DOUBLE / target AS finish FROM q, range(3) AS x(e) WHERE size > 0 AND target > 0
), run AS (SELECT *, sum(size) OVER (ORDER BY finish, h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (SELECT doc_id, sum(size) AS taken FROM run WHERE upto <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM q LEFT JOIN taken USING (doc_id)
"""


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), k=3, percent=85)
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read(spark, tokens.write(read(spark, sf_dir, "documents"), tokenizer_path()))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_deleted", "n_partners", F.sha2("text", 256).alias("kept_sha256"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), keep=False)


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's setting; without one, that of these made-up tables, which is no secret."""
    key = spark.conf.get("spark.quire.pii.key", None) or "made-up tables"
    return pii.replace_entities(read(spark, sf_dir, "documents"), key=key)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.classes(read(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP11_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{decontam.UPPER}', '{decontam.LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whiten(read(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    found = found.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each)
    return found.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a tenth of the texts made periodic from some word on, as the contract of operator
    13 sets out."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    d = d.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("ws", 1, F.col("a")), again), 1, F.col("n")), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(planted(read(spark, sf_dir, "documents")))
    each = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumns({"best": periodic.strongest(F.col("runs")), "n_runs": F.size("runs").cast("long")})
    return found.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_decontamination": op2_decontamination,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_token_ids": op4_token_ids,
        "op5_line_dedup": op5_line_dedup,
        "op6_suffix_array_dedup": op6_suffix_array_dedup,
        "op7_pii_surrogates": op7_pii_surrogates,
        "op8_html_extraction": op8_html_extraction,
        "op9_quality_rules": op9_quality_rules,
        "op10_mixing": op10_mixing,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op10_mixing": OP10_SQL, "op11_exact_dedup": OP11_SQL}
