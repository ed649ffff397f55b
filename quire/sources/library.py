"""Books as tables: segments, chapters and books of a library, ingested so that a run can be repeated.

A batch is written to folders of its own (``write``), which no reader looks at. It is then published by one
empty file whose name says all: a version, the content's key and the batch. Creating a file is one step, so a batch is
there as a whole or not at all, whatever an interrupted run has left. The key is a checksum of the rows
in any order: the same content published again, by a retry or by two runs at a time, counts once. A book
in a later version replaces the earlier one. ``vacuum`` deletes batches that were never published, or whose content
was before.

The driver lists the published files: a name a batch. Defined results: rows without a book id are left out; an empty
batch publishes nothing; equal rows of a batch all count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import progress

TABLES = ("segments", "chapters", "books")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def published(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(version, key, batch), one for each content, the first that was published."""
    fs, p = _files(spark, f"{path}/published")
    names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
    first: dict[str, tuple[int, str, str]] = {}
    for name in names:
        version, key, batch = name.split(".")
        first.setdefault(key, (int(version), key, batch))
    return sorted(first.values())


def write(segments: DataFrame, path: str) -> tuple[str, str]:
    """Writes a batch and gives its name and its content's key; nobody reads it before it is published. A book's files
    are together, but for a large one, whose rows Spark deals out."""
    spark, batch = segments.sparkSession, uuid.uuid4().hex
    of = lambda name: f"{path}/{name}/batch={batch}"
    segments.where("book_id is not null").hint("rebalance", "book_id").write.parquet(of("segments"))
    rows = spark.read.schema(segments.schema).parquet(of("segments"))
    rows.groupBy("book_id", "chapter_id").agg(F.count("*").alias("segments")).write.parquet(of("chapters"))
    progress.ingest_counts(rows).write.parquet(of("books"))
    h = F.xxhash64(*rows.columns)
    sums = rows.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)")), F.bit_xor(F.hash(*rows.columns))).first()
    return batch, "-".join("0" if v is None else f"{int(v) & (2**64 - 1):x}" for v in sums)


def ingest(segments: DataFrame, path: str) -> None:
    """Adds the books of ``segments``, or replaces them; does nothing if just this content was ingested before."""
    spark = segments.sparkSession
    batch, key = write(segments, path)
    there = published(spark, path)
    if key.startswith("0-") or any(key == k for _, k, _ in there):
        _drop(spark, path, batch)
        return
    version = max((v for v, _, _ in there), default=0) + 1
    fs, p = _files(spark, f"{path}/published/{version:012d}.{key}.{batch}")
    if not fs.createNewFile(p):
        raise OSError(f"not published: {p}")


def _drop(spark: SparkSession, path: str, batch: str) -> None:
    for name in TABLES:
        fs, p = _files(spark, f"{path}/{name}/batch={batch}")
        fs.delete(p, True)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the batches that no reader follows and gives their number. Not to be called while another run writes."""
    kept, found = {b for _, _, b in published(spark, path)}, set()
    for name in TABLES:
        fs, p = _files(spark, f"{path}/{name}")
        found |= {x.getPath().getName().removeprefix("batch=") for x in fs.listStatus(p)} if fs.exists(p) else set()
    for batch in found - kept:
        _drop(spark, path, batch)
    return len(found - kept)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the library as published: each book in its last version."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    there = published(spark, path)
    if not there:
        raise FileNotFoundError(f"nothing was published in {path}")
    rows = lambda t: spark.read.option("basePath", f"{path}/{t}").parquet(*[f"{path}/{t}/batch={b}" for _, _, b in there])
    versions = spark.createDataFrame([(b, v, k) for v, k, b in there], "batch string, version long, key string")
    books = rows("books").join(F.broadcast(versions), "batch")  # a row a batch
    last = books.groupBy("book_id").agg(F.max_by("batch", F.struct("version", "key")).alias("batch"))
    return rows(name).join(last, ["book_id", "batch"], "left_semi").drop("batch")
