"""Connected components of an edge table, by repeated minima and pointer jumping.

Every round takes each vertex's least label over itself and its neighbours, then replaces a label by its
label's label. Tables are written to the shared folder each round, so that lineage stays short and a lost
executor repeats one round at most. While labels are few they are broadcast, so that a vertex with very
many edges isn't one task's; beyond, Spark splits it. The number of rounds grows with the logarithm of a path's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import small, stage


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b); root is the least vertex of its component."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.where("a != b").distinct(), "cc-edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("root")), "cc-labels")
    while True:
        near = both.join(small(labels), F.col("b") == F.col("v")).groupBy("a").agg(F.min("root").alias("least"))
        step = labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        step = stage(step, "cc-step")
        of = step.select(F.col("v").alias("w"), F.col("root").alias("jump"))
        labels = stage(step.join(of, F.col("root") == F.col("w")).select("v", F.col("jump").alias("root"), (F.col("jump") != F.col("old")).alias("moved")), "cc-labels")
        if labels.where("moved").isEmpty():
            return labels.select("v", "root")
        labels = labels.select("v", "root")
