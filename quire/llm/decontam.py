"""Benchmark decontamination by winnowing.

Words are lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters. Of every ``window -
k + 1`` consecutive k-grams of words, the least hash is kept; so two texts that share ``window``
consecutive words keep the same k-gram of that span (of equal k-grams, the benchmark keeps all). Kept
k-grams of documents are looked up among those of the benchmark, and each hit is extended: the possible
placements of a window over the k-gram, within the 2 * window - k words around it, are looked up among the
distinct windows of the benchmark and compared word by word; so a k-gram that many items share is met
once a placement, not once an item. Items shorter than a window are one window of their own length and are
looked up whole, all lengths in one pass.

Arrays are exploded by explode_outer: from a plain explode Spark infers a filter on the array's size,
which evaluates the whole array a second time, nested.

The lookup broadcasts benchmark hashes only, in blocks of at most ``BLOCK`` hashes (8 bytes each): a
larger benchmark takes several passes over the documents, none drops anything. What is compared then
travels in ordinary joins of the hits. Windows of the same items share the number of that set of items;
hits carry the number, and each (document, set) meets its items once at the end. Documents are read once a pass; a header row a document carries
its word count, so that counting costs no second pass.

Defined results: null or empty texts have no words and are not contaminated; items without words occur
nowhere; items with a null id mark words but are not listed; equal rows each get the same result; rows
that share a doc_id but not the text are separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import small, stage

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
K, WINDOW = 5, 10
#: Benchmark hashes broadcast at a time: about 32 MB as a hash relation of longs.
BLOCK = 1_000_000
#: Ids of documents with hits that are broadcast at most, to read only those texts again; 16 bytes each.
BROADCAST_IDS = 1_000_000


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; for pure ASCII that is lower(), which is much the faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _tokenised(df: DataFrame, key: list[Column], text: str) -> DataFrame:
    """key columns, ws (words), wh (their hashes), n."""
    df = df.select(*key, words(F.col(text)).alias("ws"))
    return df.select("*", F.transform("ws", lambda w: F.xxhash64(w)).alias("wh"), F.size("ws").cast("int").alias("n"))


def _grams(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds g, the k-gram hash at each place, and m, the least of each window. The low three bits of a
    hash are its place modulo 8: a window has at most 8 k-grams, so they tell the place."""
    low = F.lit(-8).cast("long")
    gram = lambda x, i: F.xxhash64(x, *[F.get("wh", i + j) for j in range(1, k)]).bitwiseAND(low).bitwiseOR(F.pmod(i, F.lit(8)).cast("long"))
    df = df.withColumn("g", F.transform("wh", gram))
    whole = F.when(F.col("n") >= window, F.slice("g", F.lit(1), F.col("n") - (window - 1))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("m", F.transform(whole, lambda x, i: F.least(x, *[F.get("g", i + j) for j in range(1, window - k + 1)])))


def _print(m: Column, p: Column) -> Column:
    return F.struct(p.cast("int").alias("p"), F.shiftright(m, 3).alias("fp"))


def _kept(df: DataFrame, k: int, window: int) -> DataFrame:
    """Adds kept, the places and hashes of a text's kept k-grams. Arrays all the way: rows that carried
    a text's words with each of its places would grow with the square of its length."""
    place = lambda x, i: i + F.pmod(x.bitwiseAND(F.lit(7).cast("long")) - i, F.lit(8).cast("long"))
    new = F.transform("m", lambda x, i: F.when((i == 0) | (x != F.get("m", i - 1)), _print(x, place(x, i))))
    return _grams(df, k, window).withColumn("kept", F.array_compact(new))


def _kept_with_ties(df: DataFrame, k: int, window: int) -> DataFrame:
    """As _kept, but with every place of a window that has the least hash: whichever of equal k-grams
    the other text kept, the one in line with it is here."""
    df = _grams(df, k, window)
    same = F.transform(
        "m",
        lambda x, i: F.transform(
            F.filter(F.sequence(i, i + (window - k)), lambda j: F.shiftright(F.get("g", j.cast("int")), 3) == F.shiftright(x, 3)), lambda j: _print(x, j)
        ),
    )
    return df.withColumn("kept", F.array_distinct(F.flatten(same)))


def _context(ws: Column, p: Column, k: int = K, window: int = WINDOW) -> tuple[Column, Column]:
    start = F.greatest(p - (window - k), F.lit(0))
    end = F.least(p + window, F.size(ws))  # named twice, the words are not made anew for every place
    return F.slice(ws, start + 1, end - start), p - start


def _placements(ctx: Column, cp: Column, k: int, window: int) -> Column:
    """The windows over the k-gram that lie inside the context: how far before it they start, and a hash
    of all their words."""
    found = []
    for back in range(window - k, -1, -1):
        start = cp - back
        inside = (start >= 0) & (start + window <= F.size(ctx))
        words = F.slice(ctx, F.greatest(start, F.lit(0)) + 1, F.lit(window))
        found.append(F.when(inside, F.struct(F.lit(back).alias("back"), F.xxhash64(words).alias("fp"))))
    return F.array_compact(F.array(*found))


def _item_windows(items: DataFrame, window: int) -> DataFrame:
    """fp, iws and the sorted ids of all items of every distinct window: a passage of many items is one row."""
    starts = F.when(F.col("n") >= window, F.sequence(F.lit(1), F.col("n") - (window - 1))).otherwise(F.array().cast("array<int>"))
    each = items.select("item_id", F.explode_outer(F.transform(starts, lambda i: F.slice("ws", i, F.lit(window)))).alias("iws"))
    each = each.where("iws is not null").groupBy("iws").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return each.select(F.xxhash64("iws").alias("fp"), "iws", "items")


def _numbered(windows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """fp, iws and set of every window, and the item ids of each set, a row each."""
    windows = stage(windows, name)
    sets = stage(windows.select("items").distinct().select(F.monotonically_increasing_id().alias("set"), "items"), f"{name}-sets")
    each = sets.select("set", F.explode("items").alias("item"))
    return stage(windows.join(sets, "items").select("fp", "iws", "set"), f"{name}-numbered"), small(stage(each, f"{name}-items"))


def _whole_grams(lengths: list[int]) -> Column:
    """Place, length and hash of every run of wh of one of the lengths."""

    def grams(n: int) -> Column:
        gram = lambda x, i: F.struct(i.cast("int").alias("p"), F.lit(n).alias("l"), F.xxhash64(F.lit(n), x, *[F.get("wh", i + j) for j in range(1, n)]).alias("fp"))
        return F.transform(F.slice("wh", F.lit(1), F.greatest(F.col("n") - (n - 1), F.lit(0))), gram)

    return F.concat(*[grams(n) for n in lengths])


def _cutter(x: Column) -> Column:
    return F.struct(x["p"].alias("p"), x["l"].alias("l"), x["fp"].alias("fp"), F.slice("ws", x["p"] + 1, x["l"]).alias("dws"))


def _blocks(hashes: DataFrame, block: int) -> list[DataFrame]:
    """The distinct hashes in blocks that are small enough to broadcast."""
    n = hashes.count()
    parts = max(1, -(-n // block))
    if parts == 1:
        return [hashes]
    parts = -(-5 * n // (4 * block))  # room for uneven hashing
    return [hashes.where(F.pmod(F.xxhash64("fp"), F.lit(parts)) == b) for b in range(parts)]


def _of_documents(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Texts of the documents that have hits, with them; one row for equal documents."""
    hits = stage(hits, "hit-documents").select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), "hits")
    if hits.count() <= BROADCAST_IDS:
        keys = F.broadcast(hits.select("h_id", "h_key"))
        same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key"))
        docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text").join(keys, same, "left_semi")
    else:
        docs = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text")
    docs = docs.dropDuplicates(["doc_id", "text_key"])
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, k: int = K, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, text_key, n_words, n_hit, items (sorted ids as strings)."""
    if not k <= window <= k + 7:
        raise ValueError("a window holds 1 to 8 k-grams")
    items = stage(_tokenised(benchmark, [F.col("item_id").cast("string").alias("item_id")], "text").where("n > 0"), "bench-words")
    prints = _kept_with_ties(items, k, window).select(F.explode_outer("kept").alias("x")).where("x is not null")
    prints = stage(prints.select("x.fp").distinct(), "bench-prints")
    windows, items_of = _numbered(_item_windows(items, window), "bench-windows")
    listed = lambda spans, items_of: spans.select("doc_id", "text_key", "set").distinct().join(items_of, "set").select("doc_id", "text_key", "item")
    short = items.where(F.col("n") < window)
    lengths = [r.n for r in short.select("n").distinct().collect()]  # fewer than a window has words

    key = [F.col("doc_id"), F.xxhash64("doc_id", "text").alias("text_key")]
    tokens = _tokenised(docs, key, "text")
    heads = spans = None
    for hashes in _blocks(prints, block):
        known = F.broadcast(hashes.select(F.col("fp").alias("known")))
        kept = _kept(tokens, k, window).select("doc_id", "text_key", "n", "kept")
        if heads is None:
            head = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).cast("long").alias("fp")))
            kept = kept.withColumn("kept", F.concat(head, "kept"))
        found = kept.select("doc_id", "text_key", "n", F.explode_outer("kept").alias("x")).select("doc_id", "text_key", "n", "x.p", "x.fp")
        found = found.join(known, F.col("fp") == F.col("known"), "inner" if heads is not None else "left")
        found = stage(found.where((F.col("p") < 0) | F.col("known").isNotNull()).drop("known"), "decontam-hits")
        if heads is None:
            heads = found.where("p < 0").select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"))
        hits = found.where("p >= 0").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "fp")).alias("hits"))
        around = F.transform("hits", lambda x: F.struct(x["p"].alias("p"), x["fp"].alias("fp"), *(c.alias(a) for c, a in zip(_context(F.col("ws"), x["p"], k, window), ("ctx", "cp"), strict=True))))
        near = _of_documents(docs, hits).select("doc_id", "text_key", "hits", words(F.col("text")).alias("ws"))
        near = near.select("doc_id", "text_key", F.explode_outer(around).alias("x")).select("doc_id", "text_key", "x.*")
        at = F.explode_outer(_placements(F.col("ctx"), F.col("cp"), k, window)).alias("w")
        near = near.select("doc_id", "text_key", "p", "ctx", "cp", at).select("*", "w.fp").join(windows, "fp")
        near = near.where(F.slice("ctx", F.col("cp") - F.col("w.back") + 1, F.lit(window)) == F.col("iws"))
        start = F.col("p") - F.col("w.back")
        one = stage(near.select("doc_id", "text_key", "set", F.struct(start.alias("s"), (start + window).alias("e")).alias("span")).distinct(), "decontam-spans")
        spans = one if spans is None else spans.unionByName(one)
    found = listed(spans, items_of)
    if lengths:
        grams = _whole_grams(lengths)
        whole = short.select(grams.alias("g"), "n", "ws", "item_id").select(F.filter("g", lambda x: x["l"] == F.col("n"))[0]["fp"].alias("fp"), F.col("ws").alias("iws"), "item_id")
        whole, items_of = _numbered(whole.groupBy("fp", "iws").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "bench-short")
        for hashes in _blocks(whole.select("fp").distinct(), block):
            known = F.broadcast(hashes.select(F.col("fp").alias("known")))
            at = tokens.select("doc_id", "text_key", F.explode_outer(grams).alias("x")).select("doc_id", "text_key", "x.p", "x.l", "x.fp")
            at = stage(at.join(known, F.col("fp") == F.col("known")).drop("known"), "short-hits")
            hits = at.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("p", "l", "fp")).alias("hits"))
            near = _of_documents(docs, hits).select("doc_id", "text_key", "hits", words(F.col("text")).alias("ws"))
            near = near.select("doc_id", "text_key", F.explode_outer(F.transform("hits", _cutter)).alias("x")).select("doc_id", "text_key", "x.*").join(whole, "fp").where("dws = iws")
            one = near.select("doc_id", "text_key", "set", F.struct(F.col("p").alias("s"), (F.col("p") + F.col("l")).alias("e")).alias("span"))
            one = stage(one.distinct(), "short-spans")
            spans, found = spans.unionByName(one), found.unionByName(listed(one, items_of))
    spans = spans.groupBy("doc_id", "text_key").agg(F.collect_set("span").alias("spans"))
    found = found.groupBy(F.col("doc_id").alias("i_id"), F.col("text_key").alias("i_key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = spans.join(found, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key")), "left")
    start = F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("hit"))
    cover = F.aggregate(
        F.array_sort("spans"), start, lambda a, s: F.struct(F.greatest(a["e"], s["e"]).alias("e"), (a["hit"] + F.greatest(F.lit(0), s["e"] - F.greatest(a["e"], s["s"]))).alias("hit"))
    )
    spans = spans.select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key"), cover["hit"].alias("hit"), "items")
    out = heads.join(spans, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left")
    return out.select(
        "doc_id", "text_key", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with the columns of ``docs``. Only ids of documents with hits are
    joined with the texts; they are broadcast while they are few."""
    found = decontaminate(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias("h_id"), F.col("text_key").alias("h_key")).distinct()
    found = stage(found, "contaminated")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    names = docs.columns
    rows = docs.select(F.xxhash64("doc_id", "text").alias("text_key"), "doc_id", F.struct("*").alias("row"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key")), "left_anti")
    return rows.select([F.col("row").getField(c).alias(c) for c in names])
