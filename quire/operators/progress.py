"""Progress roll-ups, latest rows, leases and access, over the tables of books, jobs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.sequence import number


def ratio(a: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(a / total)


def book_progress(segments: DataFrame) -> DataFrame:
    """Failed segments count as progress."""
    g = segments.groupBy("book_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "TRANSLATED").alias("translated"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return g.withColumn("progress", ratio(F.col("translated") + F.col("failed"), F.col("total")))


def chapter_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("chapter_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "TRANSLATED").alias("translated"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def chapter_progress(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Every chapter, with zeros where it has no segments."""
    g = chapter_counts(segments)
    return chapters.select("chapter_id").join(g, "chapter_id", "left").na.fill(0, ["total", "translated", "failed"])


def latest(df: DataFrame, keys: list[str], *order: Column, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def job_rollup(jobs: DataFrame, chunks: DataFrame, max_attempts: int = 3) -> DataFrame:
    """New status of each job. Cancelled jobs and jobs without chunks keep theirs; all chunks done is
    looked at before exhausted ones."""
    g = chunks.groupBy("job_id").agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("COMPLETED", "SUPERSEDED")).alias("done"), F.count_if((F.col("status") == "FAILED") & (F.col("attempt_count") >= max_attempts)).alias("exhausted"))
    j = jobs.join(g, "job_id", "left").na.fill(0, ["n", "done", "exhausted"])
    new = F.when((F.col("status") == "CANCELED") | (F.col("n") == 0), F.col("status")).when(F.col("done") == F.col("n"), "COMPLETED").when(F.col("exhausted") > 0, "FAILED").otherwise(F.col("status"))
    return j.select("job_id", F.col("status").alias("old_status"), new.alias("status"), "n", "done", "exhausted")


def lease_eligible(chunks: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    free = F.col("locked_until").isNull() | (F.col("locked_until") < now)
    return chunks.where((F.col("attempt_count") < max_attempts) & (F.col("status").isin("PENDING", "FAILED") | ((F.col("status") == "RUNNING") & free)))


def expired(chunks: DataFrame, now: Column) -> DataFrame:
    return chunks.where((F.col("status") == "RUNNING") & (F.col("locked_until") < now))


def stale(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Running jobs that began longer ago; one without a beginning isn't stale."""
    return jobs.where((F.col("status") == "RUNNING") & F.coalesce(F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)), F.lit(False)))


def accessible(books: DataFrame, user_id: int | None, *, admin: bool = False) -> DataFrame:
    if admin:
        return books
    return books.where(F.lit(False) if user_id is None else F.col("owner_user_id") == user_id)


def dashboard_status(job: Column, book: Column) -> Column:
    """The job's state, unless pending; else the book's."""
    from_job = F.when(job == "RUNNING", "running").when(job == "COMPLETED", "completed").when(job.isin("FAILED", "CANCELED"), "failed")
    from_book = F.when(book.isin("TRANSLATED", "EXPORT_READY"), "completed").when(book == "TRANSLATING", "running").when(book == "FAILED", "failed").otherwise("pending")
    return F.coalesce(from_job, from_book)


def ingest_counts(segments: DataFrame) -> DataFrame:
    """Chapters and segments of every book. Chapters are counted one by one first, so that a book that holds
    a third of all rows is one row a chapter when books are grouped."""
    chapters = segments.groupBy("book_id", "chapter_id").agg(F.count("*").alias("n"))
    return chapters.groupBy("book_id").agg(F.count("*").alias("chapters"), F.sum("n").alias("segments"))


def page_of(segments: DataFrame, asked: Column, rows: int = 6) -> DataFrame:
    """The segments of one page of each chapter: the one that is asked for, clamped to those that there are."""
    pages = segments.groupBy("chapter_id").agg(F.ceil(F.count("*") / rows).alias("pages"))
    at = number(segments, ["chapter_id"], F.col("segment_order"), name="i").withColumn("page", (F.floor((F.col("i") - 1) / rows) + 1).cast("long"))
    return at.join(pages, "chapter_id").where(F.col("page") == F.greatest(F.lit(1), F.least(asked, F.col("pages"))))
