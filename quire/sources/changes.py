"""Notes as a log of changes: batches are applied to a table kept in buckets of keys, of which only touched ones are rewritten.

A change is create, update or delete of a note by an actor at a time (``note_id, change_id, at, op, actor, admin, content``). A
note is its creator's: changes of others count only from admins. It ends with its first delete that counts; its ids
are not used again. What a note is follows from its changes in order of (at, change_id), whenever they come: so a
bucket keeps its changes beside its notes, and a late change is taken where it belongs. Applying batches one
after another, twice or in another order gives what one replay of all changes gives.

``replay`` holds no note's changes together: the creator is the least create, the end the least delete that counts, the
content the last update that counts before it; a note with very many changes is joined with its one creator, which
Spark splits.

A batch writes its buckets to a folder of its own and is published by one empty file whose name has a number, the folder and the
buckets as bits; readers take each bucket from the last one that has it. One writer at a time.

Defined results: changes without a note or change id are left out; a repeated change id is one change; an empty batch publishes
nothing; a time that is null comes first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.library import _files

BUCKETS = 32
COLUMNS = ("note_id", "change_id", "at", "op", "actor", "admin", "content")


def replay(changes: DataFrame) -> DataFrame:
    """``note_id, creator, content, created_at, updated_at, deleted, refused`` of each note that was created."""
    order = F.struct("at", "change_id").alias("order")
    c = changes.where("note_id is not null and change_id is not null").dropDuplicates(["note_id", "change_id"]).select("*", order)
    made = c.where("op = 'create'").groupBy("note_id").agg(F.min(F.struct("order", "actor", "content")).alias("made"))
    c = c.join(made, "note_id")
    counts = (F.col("op") != "create") & (F.col("order") > F.col("made.order")) & (F.coalesce(F.col("admin"), F.lit(False)) | F.col("actor").eqNullSafe(F.col("made.actor")))
    c = c.withColumn("counts", counts)
    ends = c.where("counts and op = 'delete'").groupBy("note_id").agg(F.min("order").alias("end"))
    c = c.join(ends, "note_id", "left").withColumn("counts", F.col("counts") & (F.col("end").isNull() | (F.col("order") <= F.col("end"))))
    update = F.col("counts") & (F.col("op") == "update")
    first = F.col("order") == F.col("made.order")
    n = c.groupBy("note_id").agg(
        F.any_value("made").alias("made"), F.any_value("end").alias("end"), F.max(F.when(update, F.struct("order", "content"))).alias("last"), F.count_if(~F.col("counts") & ~first).alias("refused"),
    )
    content = F.when(F.col("last").isNotNull(), F.col("last.content")).otherwise(F.col("made.content"))
    return n.select("note_id", F.col("made.actor").alias("creator"), content.alias("content"), F.col("made.order.at").alias("created_at"), F.coalesce("last.order.at", "made.order.at").alias("updated_at"), F.col("end").isNotNull().alias("deleted"), "refused")


def _published(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The last number, and of each bucket the folder that holds it."""
    fs, p = _files(spark, f"{path}/published")
    last, of = 0, {}
    for name in sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []:
        number, folder, bits = name.split(".")
        last = int(number)
        of |= {b: folder for b in range(BUCKETS) if int(bits, 16) >> b & 1}
    return last, of


def _read(spark: SparkSession, path: str, of: dict[int, str], what: str) -> DataFrame | None:
    """A table of these buckets, each from its folder."""
    if not of:
        return None
    return spark.read.option("basePath", f"{path}/{what}").parquet(*[f"{path}/{what}/batch={f}/bucket={b}" for b, f in sorted(of.items())]).drop("batch")


def apply(changes: DataFrame, path: str) -> list[int]:
    """Applies a batch and gives the buckets that it has rewritten."""
    spark, folder = changes.sparkSession, uuid.uuid4().hex
    new = changes.where("note_id is not null and change_id is not null").select(*COLUMNS, F.pmod(F.xxhash64("note_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
    if not touched:
        return []
    last, of = _published(spark, path)
    old = _read(spark, path, {b: f for b, f in of.items() if b in touched}, "changes")
    every = new if old is None else old.select(new.columns).unionByName(new)
    every.dropDuplicates(["note_id", "change_id"]).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/changes/batch={folder}")
    log = _read(spark, path, dict.fromkeys(touched, folder), "changes")
    notes = replay(log).withColumn("bucket", F.pmod(F.xxhash64("note_id"), F.lit(BUCKETS)).cast("int"))
    notes.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/notes/batch={folder}")
    fs, p = _files(spark, f"{path}/published/{last + 1:012d}.{folder}.{sum(1 << b for b in touched):x}")
    if not fs.createNewFile(p):
        raise OSError(f"not published: {p}")
    return touched


def notes(spark: SparkSession, path: str, *, deleted: bool = False) -> DataFrame:
    """The notes as they are now; those that are deleted too, if asked for."""
    _, of = _published(spark, path)
    there = {b: f for b, f in of.items() if _files(spark, f"{path}/notes/batch={f}/bucket={b}")[0].exists(_files(spark, f"{path}/notes/batch={f}/bucket={b}")[1])}
    found = _read(spark, path, there, "notes")
    if found is None:
        raise FileNotFoundError(f"no note was published in {path}")
    return found.drop("bucket") if deleted else found.where("not deleted").drop("bucket")
