"""Near-duplicate documents by SetSketch registers.

1. Each document's distinct word shingles give 128 registers of 16 bits (``sketch``). Documents of equal
   sets are one class from here on, however many they are.
2. Bands of 4 registers are compared for equality: classes that share a band value are candidates. Two
   sets of similarity 0.85 miss each other in all 32 bands with probability 6e-11.
3. In every bucket the class that shares most buckets is the hub. Every (class, hub) pair is verified on
   the full sets, exactly: one pair for each bucket entry at most, whatever a bucket's size. Pairs of a
   popular hub are dealt out by salt, and the hub's set is sent once for each salt.
4. Verified links connect classes. A hub whose classes are all connected is done; mostly all are. For the
   rest, the exact distances to the hub bound all others (Jaccard distance is a metric): only classes that
   aren't connected yet and whose distances to the hub differ by no more than a link's can be linked.
   Classes of such a hub are cut into cells of that width by their distance to it, large cells into blocks
   by hash; a cell meets itself and the next one, block by block, where registers refute most pairs by
   joint likelihood (six standard deviations) and full sets decide. No task holds more than two blocks,
   every pair that may be linked meets, and pairs of classes never become rows.
5. Verified links give components; a document's component is the least doc_id in it.

Defined results: null and empty texts, or texts without words, have an empty set and are linked with
nothing; fewer words than a shingle's are one shingle; equal rows are in one component and share its
verdict; a null doc_id counts after all others; extra columns are ignored here and kept by
``drop_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import sketch
from quire.llm.components import components
from quire.llm.store import parallelism, small, stage
from quire.llm.vec import chunks, column, release

#: Classes and shingles of a block, and classes of a hub that one salt takes. Up to BLOCKS blocks, a
#: larger cell has larger ones.
BLOCK, BLOCK_MOST, BLOCKS, BLOCK_SHINGLES, SALT = 256, 4096, 12, 1_500_000, 64
#: Ids that are broadcast at most; 16 bytes each. Beyond, the join is left to Spark.
BROADCAST_IDS = 1_000_000


def _sketches(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(2))
            for a, b in chunks(offsets):
                elements, bounds = sketch.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                n = b - a
                values = sketch.bands(sketch.registers(elements, bounds)).view(np.int64).reshape(-1)
                per = sketch.M // sketch.ROWS
                node = pa.array([x.tobytes() for x in sketch.identity(elements, bounds)], pa.binary())
                arrays = [
                    batch.column(0).slice(a, n),
                    batch.column(1).slice(a, n),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    node,
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per, dtype=np.int32)), pa.array(values)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "n", "node", "bands"])
        release()

    return task


def _sets(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column(batch.column(1))
            for a, b in chunks(offsets):
                elements, bounds = sketch.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                regs = sketch.registers(elements, bounds)
                listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.view(np.int64)))
                arrays = [batch.column(0).slice(a, b - a), listed, pa.array([r.tobytes() for r in regs], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["node", "elements", "registers"])
        release()

    return task


def links(elements: list[np.ndarray], regs: np.ndarray, side: np.ndarray, known: np.ndarray, far: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links of the sets that connect what isn't connected: 100 * |intersection| >= percent * |union|.
    With two sides, only pairs across are compared. known: number of each set's component so far; far: its
    distance to a common third set."""
    n = len(elements)
    size = np.array([len(e) for e in elements], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    _, dense = np.unique(np.concatenate(elements), return_inverse=True)
    flag = np.zeros(int(dense.max()) + 1, np.int64)
    root = known.copy()
    two = side.min() != side.max()
    out = []
    for i in range(n):
        other = (root != root[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (np.abs(far - far[i]) <= 1 - percent / 100 + 1e-9)
        other[: i + 1] = False
        if two:
            other &= side != side[i]
        j = np.flatnonzero(other)
        if not len(j):
            continue
        more, less = (regs[i] > regs[j]).sum(1), (regs[i] < regs[j]).sum(1)
        j = j[sketch.may_reach(percent / 100, np.full(len(j), size[i]), size[j], more, less)]
        if not len(j):
            continue
        mine = dense[at[i] : at[i + 1]]
        flag[mine] = 1
        starts = np.concatenate([[0], np.cumsum(size[j])])
        places = np.arange(starts[-1]) - np.repeat(starts[:-1] - at[j], size[j])
        both = np.add.reduceat(flag[dense[places]], starts[:-1])
        flag[mine] = 0
        for x in j[100 * both >= percent * (size[i] + size[j] - both)]:
            if root[x] != root[i]:
                out.append((i, int(x)))
                root[root == root[x]] = root[i]
    return out


def _verify(percent: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def done() -> pa.RecordBatch:
            elements = [r[1] for r in rows]
            regs = np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
            number: dict = {}
            known = np.array([number.setdefault(r[4], len(number)) for r in rows])
            found = links(elements, regs, np.array([r[3] for r in rows]), known, np.array([r[5] for r in rows]), percent)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in found], pa.binary()), pa.array([rows[j][0] for _, j in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                keys = zip(*(some.column(i).to_pylist() for i in range(3)), strict=True)
                sets = [some.column(4)[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for i in range(some.num_rows)]
                for key, node, elements, *row in zip(keys, some.column(3).to_pylist(), sets, *(some.column(i).to_pylist() for i in range(5, 9)), strict=True):
                    if key != group:
                        if len(rows) > 1:
                            yield done()
                        group, rows = key, []
                    rows.append((node, elements, *row))
        if len(rows) > 1:
            yield done()
        release()

    return task


def _to_hubs(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, hub, far, cell, linked) of all (node, hub) pairs: the exact distance, how many times a
    link's it is, and whether it is one's."""
    n_salts = F.ceil(F.col("classes") / SALT).cast("int")
    of_hub = stage(stars.groupBy("hub").agg(F.count("*").alias("classes")), "hub-sizes")
    salted = stars.join(small(of_hub.select("hub", n_salts.alias("n_salts"))), "hub").select("node", "hub", F.pmod(F.xxhash64("node"), "n_salts").cast("int").alias("salt"))
    hub_sets = of_hub.join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("theirs")), "hub")
    hub_sets = hub_sets.select("hub", "theirs", F.explode(F.sequence(F.lit(0), n_salts - 1)).alias("salt"))
    met = salted.join(sets.select("node", F.col("elements").alias("own")), "node").join(hub_sets, ["hub", "salt"])
    both = F.size(F.array_intersect("own", "theirs"))
    met = met.select("node", "hub", both.alias("both"), (F.size("own") + F.size("theirs") - both).alias("all"))
    cell = F.expr(f"(100L * (all - both)) div ({max(1, 100 - percent)}L * all)")  # in links' widths, exactly
    return met.select("node", "hub", (1 - F.col("both") / F.col("all")).alias("far"), cell.alias("cell"), (100 * F.col("both") >= percent * F.col("all")).alias("linked"))


def _left(measured: DataFrame, connected: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes that share a hub and aren't connected through hubs."""
    spark = measured.sparkSession
    of = connected.select(F.col("v").alias("node"), F.col("root").alias("component"))
    hubs = measured.select("hub").distinct().select("hub", F.col("hub").alias("node"), F.lit(0.0).alias("far"), F.lit(0).cast("long").alias("cell"))
    all_of = measured.select("hub", "node", "far", "cell").unionByName(hubs).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    all_of = stage(all_of, "hub-classes")
    all_of = all_of.join(members.select("node", "n"), "node")
    several = all_of.groupBy("hub").agg((F.min("component") != F.max("component")).alias("several"), ((F.count("*") <= BLOCK) & (F.sum("n") <= BLOCK_SHINGLES)).alias("few"))
    several = small(stage(several.where("several").select("hub", "few"), "hubs-left"))
    # the classes of a hub that has few are one cell of their own
    rest = all_of.join(several, "hub").withColumn("cell", F.when(F.col("few"), F.lit(-9)).otherwise(F.col("cell")).cast("long"))
    cells = rest.groupBy("hub", "cell").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"))
    per_block = F.least(F.greatest(F.col("count") / BLOCKS, F.lit(BLOCK)), F.lit(BLOCK_MOST))
    blocks = F.greatest(F.ceil(F.col("count") / per_block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    cells = stage(cells.select("hub", "cell", blocks.alias("blocks")), "hub-cells")
    beside = cells.select("hub", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("after")), cells.select("hub", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("before"))
    cells = cells.join(beside[0], ["hub", "cell"], "left").join(beside[1], ["hub", "cell"], "left").na.fill(0, ["after", "before"])
    placed = rest.join(small(stage(cells, "hub-cells-beside")), ["hub", "cell"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).join(sets, "node")
    # the groups a class is in: its block with every block of its own cell, of the cell after it and of the one before it
    name = lambda cell, block: F.struct(cell.alias("cell"), block.alias("block"))
    others = lambda n, cell: F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda b: name(cell, b))).otherwise(F.array().cast("array<struct<cell:bigint,block:int>>"))
    own = name(F.col("cell"), F.col("block"))
    other = F.concat(others(F.col("blocks"), F.col("cell")), others(F.col("after"), F.col("cell") + 1), others(F.col("before"), F.col("cell") - 1))
    met = placed.select("*", own.alias("mine"), F.explode(other).alias("other"))
    met = met.select("hub", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "elements", "registers", "mine", "component", "far")
    met = met.where((F.col("lo.cell") != 0) | (F.col("hi.cell") != 0))  # all of cell 0 are linked with the hub
    key = [F.col("hub"), F.concat_ws(".", F.col("lo.cell"), F.col("lo.block")).alias("lo"), F.concat_ws(".", F.col("hi.cell"), F.col("hi.block")).alias("hi")]
    met = met.select(*key, "node", "elements", "registers", (F.col("mine") == F.col("lo")).cast("int").alias("side"), "component", "far")
    met = met.repartition(parallelism(spark), "hub", "lo", "hi").sortWithinPartitions("hub", "lo", "hi")
    return met.mapInArrow(_verify(percent), "a binary, b binary")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every document, and first: whether it is the
    one of its component that stays."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), F.col("text").cast("string").alias("text"))
    fields = "doc_id bigint, text_key bigint, n bigint, node binary, bands array<bigint>"
    each = stage(keyed.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_sketches(k), fields), "sketches")

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    full = each.where("n > 0")
    classes = stage(full.groupBy("node").agg(F.min(order).alias("lead"), F.min("n").alias("n"), F.first("bands").alias("bands")), "classes")

    entries = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    shared = stage(entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    entries = stage(entries.join(shared, "bucket"), "bucket-entries")
    weight = stage(entries.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    hubs = entries.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    hubs = stage(hubs, "hubs")
    stars = entries.join(hubs, "bucket").where("node != hub").select("node", "hub").distinct()
    stars = stage(stars, "stars")
    names = stars.select("node").unionAll(stars.select(F.col("hub").alias("node"))).distinct()
    members = stage(names.join(classes.select("node", "lead", "n"), "node"), "members")
    leads = members.select(F.col("lead.doc_id").alias("lead_id"), F.col("lead.text_key").alias("lead_key"), "node")
    if leads.count() <= BROADCAST_IDS:
        leads = F.broadcast(leads)
    texts = keyed.join(leads, (F.col("text_key") == F.col("lead_key")) & F.col("doc_id").eqNullSafe(F.col("lead_id"))).select("node", "text")
    sets = stage(texts.mapInArrow(_sets(k), "node binary, elements array<bigint>, registers binary"), "sets")
    if sets.count() > members.count():  # equal rows
        sets = stage(sets.dropDuplicates(["node"]), "sets")

    measured = stage(_to_hubs(stars, sets.select("node", "elements"), percent), "hub-distances")
    direct = measured.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    connected = components(direct)
    more = stage(_left(measured, connected, members, sets, percent), "links-left")
    linked = connected.select(F.col("v").alias("a"), F.col("root").alias("b")).unionAll(more)

    joined = connected if more.isEmpty() else components(linked)
    of_class = classes.join(joined, F.col("node") == F.col("v"), "left").select("node", F.coalesce("root", "node").alias("root"), "lead")
    of_root = of_class.groupBy("root").agg(F.min("lead").alias("first"))
    verdict = stage(of_class.join(of_root, "root").select("node", "first"), "verdicts")
    out = each.where("n > 0").join(verdict, "node").select("doc_id", "text_key", "n", "first")
    alone = each.where("n = 0").select("doc_id", "text_key", "n", order.alias("first"))
    out = out.unionAll(alone)
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), stays.alias("first"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, with the columns of ``docs``; of equal rows one stays. Only ids of
    documents that go are joined with the texts; they are broadcast while they are few."""
    found = near_duplicates(docs, **options).groupBy(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key")).agg(F.bool_or("first").alias("first"), F.count("*").alias("n"))
    found = stage(found.where("not first or n > 1"), "near-duplicates")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    names, same = docs.columns, (F.col("text_key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_id"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), F.struct("*").alias("row"))
    stay = rows.join(found, same, "left_anti").select("row")
    equal = rows.join(found.where("first"), same, "left_semi").groupBy("doc_id", "text_key").agg(F.first("row").alias("row"))
    return stay.unionAll(equal.select("row")).select([F.col("row").getField(c).alias(c) for c in names])
