"""Order without a group in one task: positions, running values and greedy packing over sequences of any length.

A sequence is the rows of one key, in an order. ``number`` deals rows out by ranges of (key, order), counts
each bucket and adds the counts of the buckets before. With positions, a sequence is cut into blocks, so no
task ever needs more than a block of it: ``running`` computes within blocks and adds what the blocks before
come to, one row a block.

``pack`` cuts sequences greedily: a piece takes items as long as two budgets hold, and at least one. Where a
sequence has several blocks, a block is a function: from the item that begins its first piece, which is one of the
few that a piece of the block before could not take, to the item that begins the first one of the next block.
These functions are composed by doubling. So a sequence is cut in as many tasks as it has blocks, in a
number of rounds that is the logarithm of that.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import stage

#: Places of a block whose rows are computed together.
ROWS = 4096
#: Rows of a task, about, where rows are dealt out by a key.
TASK = 1_000_000
#: Items of a block of the packer, whose successors are held in one array.
ITEMS = 256


def _same(keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])


def _running(d: DataFrame, keys: list[str], order: list[Column], sums: Mapping[str, Column], before: Mapping[str, Column]) -> DataFrame:
    """``d``: rows that are fixed, in blocks (``_block``) that rise with the order."""
    last = [F.struct(*[v.alias(k) for k, v in before.items()]).alias("_last")] if before else []
    names = [c for c in d.columns if c != "_block"]
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = d.select("*", *[v.cast("long").alias(f"_s_{k}") for k, v in sums.items()], *last, F.row_number().over(inner).alias("_row"))
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_s_{k}").alias(f"_s_{k}") for k in sums], *[F.max_by("_last", "_row").alias("_last") for _ in last], F.count("*").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_block")  # a row a block
    ahead = over.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *[F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_s_{k}") for k in sums], *[F.lag("_last").over(over).alias("_before") for _ in last])
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # by rows: ties have places of their own
    inside = [F.sum(f"_s_{k}").over(upto).alias(f"_i_{k}") for k in sums] + [F.lag("_last").over(inner).alias("_i_last") for _ in last]
    both = rows.select(*names, "_block", "_row", *inside).alias("a").join(blocks.alias("b"), _same([*keys, "_block"]))
    out = [(F.col(f"_i_{k}") + F.col(f"_s_{k}")).alias(k) for k in sums]
    out += [F.when(F.col("_row") == 1, F.col("_before")[k]).otherwise(F.col("_i_last")[k]).alias(k) for k in before]
    return both.select(*[f"a.{c}" for c in names], *out)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by the keys, to more tasks where it has more rows, so that a task's memory doesn't grow with the table.
    Its rows are counted first: it should be a plain read of a table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // TASK)), *keys)


def number(df: DataFrame, keys: list[str], *order: Column, name: str = "position", before: Mapping[str, Column] = {}) -> DataFrame:
    """Adds each row's place among those of its key, from 1 on, and values of the row before (null for the first).
    Rows that the order doesn't tell apart stand in any order."""
    rows = stage(df, "rows")  # read twice: for the ranges' bounds too
    ranged = stage(rows.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()), "ranged")
    return _running(ranged, keys, list(order), {name: F.lit(1)}, before)


def running(df: DataFrame, keys: list[str], place: str, *, sums: Mapping[str, Column] = {}, before: Mapping[str, Column] = {}) -> DataFrame:
    """Adds running sums up to and with each row, and values of the row before (null for the first). ``place``:
    whole numbers in order, which need not follow on one another."""
    fixed = stage(df.withColumn("_block", F.floor(F.col(place) / ROWS)), "placed")
    return _running(fixed, keys, [F.col(place)], sums, before)


def pack(items: DataFrame, keys: list[str], place: str, count: str, size: str, *, most: int, target: int, forced: Column | None = None) -> DataFrame:
    """``items`` with the number of their piece (``piece``), from 0 on in each key. Places are whole numbers from 0 on,
    of which up to half may be missing, no two in a row; counts are 1 or more; a piece holds up to ``most`` counts and up to ``target``
    of size, or one item that is beyond. A ``forced`` item begins a piece in any case."""
    if not 0 < 2 * most <= ITEMS:
        raise ValueError(f"a piece holds 1 to {ITEMS // 2} items")
    block = F.floor(F.col(place) / ITEMS)
    begins = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    item = F.struct(*[F.col(c) for c in items.columns if c not in keys])
    each = F.struct(F.col(place).cast("long").alias("p"), F.col(count).cast("long").alias("n"), F.col(size).cast("long").alias("z"), begins.alias("f"), item.alias("item"))
    blocks = items.select(*keys, block.alias("_block"), each.alias("x")).groupBy(*keys, "_block").agg(F.array_sort(F.collect_list("x")).alias("_x"))  # ITEMS at most
    blocks = _entered(stage(blocks, "packer-blocks"), keys, most, target)

    numbers = F.aggregate(
        F.transform("_x", lambda x, i: F.struct(x["n"], x["z"], x["f"], i.alias("i"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("z"), F.lit(-1).alias("piece"), F.array().cast("array<int>").alias("out")),
        lambda a, x: _numbered(a, x, F.when(x["i"] < F.col("_entry"), F.lit(False)).otherwise((x["i"] == F.col("_entry")) | _full(a, x, most, target))),
        lambda a: a["out"],
    )
    blocks = blocks.withColumn("_numbers", numbers)
    ended = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    begun = F.coalesce(F.sum(F.element_at("_numbers", -1) + 1).over(ended), F.lit(0))
    blocks = blocks.withColumn("_begun", begun)
    rows = blocks.select(*keys, "_begun", F.explode_outer(F.arrays_zip("_x", "_numbers")).alias("y"))  # outer: no filter by size, which would number twice
    rest = [F.col("y._x.item")[c].alias(c) for c in items.columns if c not in keys]
    return rows.select(*keys, *rest, (F.col("_begun") + F.col("y._numbers")).alias("piece")).select(*items.columns, "piece")


def _full(a: Column, x: Column, most: int, target: int) -> Column:
    return x["f"] | (a["n"] + x["n"] > most) | (a["z"] + x["z"] > target)


def _numbered(a: Column, x: Column, new: Column) -> Column:
    n, z = F.when(new, x["n"]).otherwise(a["n"] + x["n"]), F.when(new, x["z"]).otherwise(a["z"] + x["z"])
    piece = a["piece"] + new.cast("int")
    return F.struct(n.alias("n"), z.alias("z"), piece.alias("piece"), F.concat(a["out"], F.array(piece)).alias("out"))


def _entered(blocks: DataFrame, keys: list[str], most: int, target: int) -> DataFrame:
    """Adds which item of a block begins its first piece (``_entry``): the first one in a sequence's first block."""
    last = blocks.agg(F.max("_block")).first()[0] or 0
    if not last:
        return blocks.withColumn("_entry", F.lit(0))
    narrow = blocks.select(*keys, "_block", F.transform("_x", lambda x: F.struct(x["n"], x["z"], x["f"])).alias("_x"))
    after = narrow.where("_block > 0").select(*keys, (F.col("_block") - 1).alias("_block"), F.slice("_x", 1, most + 1).alias("_y"))
    hop = narrow.alias("a").join(after.alias("b"), _same([*keys, "_block"])).select(*[f"a.{k}" for k in keys], "a._block", "_x", "_y")
    # a block as a function: from the item that begins its first piece, to the one of the next block that begins the first piece there
    long = lambda v: F.lit(v).cast("long")
    state = lambda n, z, out: F.struct(n.alias("n"), z.alias("z"), out.cast("int").alias("out"))

    def through(entry: Column) -> Column:
        def inside(a: Column, x: Column) -> Column:
            new = (x["i"] == entry) | _full(a, x, most, target)
            return F.when(x["i"] < entry, a).otherwise(state(F.when(new, x["n"]).otherwise(a["n"] + x["n"]), F.when(new, x["z"]).otherwise(a["z"] + x["z"]), F.lit(-1)))

        def beyond(a: Column, x: Column) -> Column:
            return F.when(a["out"] >= 0, a).when(_full(a, x, most, target), state(a["n"], a["z"], x["i"])).otherwise(state(a["n"] + x["n"], a["z"] + x["z"], F.lit(-1)))

        at = lambda xs: F.transform(xs, lambda x, i: F.struct(x["n"], x["z"], x["f"], i.alias("i")))
        left = F.aggregate(at(F.col("_x")), state(long(0), long(0), F.lit(-1)), inside)
        return F.aggregate(at(F.col("_y")), left, beyond, lambda a: a["out"])

    entries = F.sequence(F.lit(0), F.least(F.lit(most), F.size("_x") - 1))
    # ``_map`` of a block: from the entry of an earlier block to its own; the earlier one recedes to the first
    maps, reach = hop.select(*keys, (F.col("_block") + 1).alias("_block"), F.transform(entries, through).alias("_map")), 1
    while reach < last:
        maps = stage(maps, "packer-maps")
        earlier = maps.select(*keys, (F.col("_block") + reach).alias("_block"), F.col("_map").alias("_earlier"))
        both = maps.alias("a").join(earlier.alias("b"), _same([*keys, "_block"]), "left")
        composed = F.transform("_earlier", lambda e: F.get("_map", e))
        maps, reach = both.select(*[f"a.{k}" for k in keys], "a._block", F.coalesce(composed, F.col("_map")).alias("_map")), 2 * reach
    both = blocks.alias("a").join(maps.alias("b"), _same([*keys, "_block"]), "left")
    return both.select(*[f"a.{c}" for c in blocks.columns], F.coalesce(F.get("_map", F.lit(0)), F.lit(0)).alias("_entry"))
