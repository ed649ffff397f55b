"""Tables that an operator writes once and reads several times.

They go to the folder named by ``spark.checkpoint.dir``, which every executor shares, as Parquet:
reading them back prunes columns, and a lost executor costs nothing, since no task depends on
another machine's disk.

They stay as long as results may be read that were made of them: results are lazy. ``clear`` deletes all
that an application has written; a driver calls it when its results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow staged table (ids, counts) that is broadcast at most: tens of MB.
BROADCAST_ROWS = 300_000
#: Bytes of an Arrow batch while a table is staged: what a task holds of its input at once.
BATCH = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A folder of our own is set only where none is named and
    the master is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-quire-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame) -> DataFrame:
    """A narrow staged table, marked for broadcast if its rows, counted, are few; else Spark deals it out."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged. Results that aren't written yet are lost with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that one exchange of this session is dealt over; what is cut into buckets follows it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
