"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a keyed hash and served at a rate in proportion to its target: a
document's virtual finish time is the running sum of its source's tokens up to and including it,
divided by the source's target. Documents of all sources, sorted by finish time, are taken until the
total budget is used. A source whose target exceeds its size is passed through again (at most
``max_epochs`` times), with finish times that continue where the pass before ended.

Neither running sum puts a group into one task. Within a source, hash order is cut into buckets of
equal width: sums of (source, bucket) give every bucket's offset, and only a bucket is sorted. For
the global order, finish times are cut into ranges of equal width, which hold about the same number
of tokens each, because fair queueing spreads tokens evenly over virtual time. The number of buckets
and ranges follows the session's parallelism.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is never taken; sources of size 0 have target 0; rows that are equal are separate
documents and are interchangeable; an empty table gives an empty result. Extra columns ride along in
``schedule(..., keep_row=True)``, nested, so that their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import parallelism, small, stage

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: str) -> Column:
    """60 bits of a digest of seed and id: the same in every run."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, weigh ``weights``, repeating. The total size is shared by
    weight; a target stops at ``max_epochs`` times the source's size and the excess is shared anew.
    The end of that is a common level: target = min(cap, level * weight), where the capped sources
    are a prefix of the order by cap / weight. One row a source: the ordered windows over all sources
    see as many rows as there are sources, not documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rest_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumns({"rest": rest, "rest_w": rest_w})
    # a source is capped if the level that all from it on would reach is at or over its own ratio
    per = per.withColumn("capped", F.col("rest") * F.col("w") >= F.col("cap") * F.col("rest_w"))
    level = Window.orderBy("capped").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free_rest = F.max(F.when(~F.col("capped"), F.struct(F.col("rest_w"), F.col("rest")))).over(level)
    per = per.withColumn("free", free_rest)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("free.rest") * F.col("w")).cast("double") / F.col("free.rest_w").cast("double")
    )
    return per.select("source", "source_size", target.alias("target"))


def schedule(
    docs: DataFrame, *, text: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix", keep_row: bool = False
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, finish (array of the virtual
    finish times of the passes that the mix takes, in order), n_taken; with ``keep_row`` also ``row``,
    the whole input row."""
    spark = docs.sparkSession
    n_buckets = 1
    while n_buckets < 8 * parallelism(spark):
        n_buckets *= 2
    width = F.lit((1 << HASH_BITS) // n_buckets)

    def keyed(df: DataFrame, *more: Column) -> DataFrame:
        h = shuffle_key(F.col("doc_id"), seed)
        df = df.select(F.col("doc_id"), F.col("source"), word_count(F.col(text)).alias("size"), h.alias("h"), *more)
        return df.withColumn("bucket", F.floor(F.col("h") / width).cast("int"))

    sized = stage(keyed(docs), "mix-sizes")
    targets = small(stage(source_targets(sized.select("source", "size"), weights, max_epochs), "mix-targets"))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("offset"))
    offsets = small(stage(offsets, "mix-offsets"))  # a row for each bucket of a source

    rows = keyed(docs, F.struct("*").alias("row")) if keep_row else sized
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside)).alias("d")
    o, t = offsets.alias("o"), targets.alias("t")
    rows = (
        rows.join(o, F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
        .join(t, F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "d.h", *(["d.row"] if keep_row else []), "t.source_size", "t.target", (F.col("o.offset") + F.col("d.inside")).alias("cum"))
    )
    passes = F.array(*[((F.lit(e) * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")) for e in range(max_epochs)])
    rows = rows.withColumn("all", F.when((F.col("size") > 0) & (F.col("target") > 0), passes).otherwise(F.array().cast("array<double>")))
    copies = stage(rows.select("doc_id", "source", "size", "source_size", "target", "h", "all"), "mix-finish")
    cut = _cut(copies, n_buckets, max_epochs)
    if not keep_row:
        rows = copies
    rows = rows.join(F.broadcast(cut), how="cross")  # one row: the place of the cut
    c = F.col("cut")
    place = F.struct(F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc_id"))
    taken = F.filter("all", lambda f: (f < c["finish"]) | ((f == c["finish"]) & (place <= c["place"])))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("finish"), F.size(taken).cast("long").alias("n_taken"), *(["row"] if keep_row else [])
    )


def _cut(copies: DataFrame, n_ranges: int, max_epochs: int) -> DataFrame:
    """One row, ``cut``: the last copy in order of (finish, h, doc_id) up to which the sizes of all
    copies fit the total budget. Sums of the ranges of finish times tell the range in which it lies;
    only that range is sorted."""
    copy = copies.select(
        "size", F.col("h"), F.coalesce(F.col("doc_id"), F.lit(-1)).alias("doc_id"), F.explode("all").alias("finish")
    ).withColumn("range", F.least(F.floor(F.col("finish") * n_ranges), F.lit(n_ranges * (max_epochs + 1))).cast("int"))
    budget = copies.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    sums = copy.groupBy("range").agg(F.sum("size").alias("s"))
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)  # one row a range
    sums = sums.select("range", "s", F.sum("s").over(upto).alias("upto"))
    over = sums.join(F.broadcast(budget), how="cross").withColumn("room", F.col("budget") - (F.col("upto") - F.col("s")))
    crossing = over.where(F.col("upto") > F.col("budget")).agg(F.min(F.struct("range", "room")).alias("x"))
    last = over.agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("range"))).alias("full"))
    at = crossing.join(F.broadcast(last), how="cross")
    inside = copy.join(F.broadcast(at), F.col("range") == F.col("x.range"))
    run = Window.partitionBy("range").orderBy("finish", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("run", F.sum("size").over(run)).where(F.col("run") <= F.col("x.room"))
    fit = inside.agg(F.max(F.struct("finish", F.struct("h", "doc_id").alias("place"))).alias("fit"))
    nothing = F.struct(F.lit(float("inf")).alias("finish"), F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("doc_id")).alias("place"))
    below = F.struct(
        (F.col("x.range") / F.lit(float(n_ranges))).alias("finish"), F.struct(F.lit(-1).cast("long").alias("h"), F.lit(-1).cast("long").alias("doc_id")).alias("place")
    )
    return at.join(F.broadcast(fit), how="cross").select(
        F.when(F.col("x").isNull(), nothing).otherwise(F.coalesce(F.col("fit"), below)).alias("cut")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``, each as many times as it is taken, range-sorted
    by virtual finish time."""
    names = docs.columns
    rows = schedule(docs, keep_row=True, **options)
    out = rows.select("row", "doc_id", F.explode("finish").alias("at"))
    n = parallelism(docs.sparkSession)
    out = out.repartitionByRange(n, "at", "doc_id").sortWithinPartitions("at", "doc_id")
    return out.select([F.col("row").getField(c).alias(c) for c in names])
