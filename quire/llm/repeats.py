"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts earlier: in a document of a
smaller id, or earlier in the same one. Strings are judged on the input.

1. Texts are gathered in blocks. The places of a text are cut into segments: maximal runs of window
   starts whose windows have their least ``GRAM``-byte hash, the anchor, at the same place. So equal
   windows lie in segments of the same anchor, whichever documents they stand in, and never in the same
   segment.
2. Each block sends every distinct (anchor, content) of its segments once, with its first place, to
   buckets by hash range. A bucket finds for every content whether it stands anywhere earlier, in which
   case the whole segment goes, and which anchors have several contents.
3. First occurrences of those go, as texts, to buckets by anchor. A bucket splits them into shards, makes
   a Burrows-Wheeler transform of each and merges all by interleave refinement (``bwt``); the intervals of
   ``LENGTH`` common bytes tell equal windows, of which only the first stays.
4. Blocks get the answers in the order they asked, and cut their texts.

Contents of an anchor are told apart by 64-bit hashes, beside the 64 bits of the anchor.

Anchors that are frequent in the corpus are known from the distinct contents of all blocks, of which those
with a hash of one class in ``REPORT`` are counted, however few a block has. Their windows are compared one
by one, by two independent 64-bit hashes of all their bytes, each distinct one sent once by a block, so that no bucket holds a hot
anchor. There is about one for ``HOT`` distinct segments at most. Up to ``CARRIED`` of them travel with the
tasks; more are joined with the blocks that hold them, so that each block is told its own. Which anchors are hot decides on the way to the answer only, not on the answer.

Defined results: null and empty texts have no bytes; a null id comes after all others; rows of the same
id are in order of a hash of their text; equal rows count as one document and get the same result; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import bwt
from quire.llm.lm import _groups, _unzip, _zip
from quire.llm.store import parallelism, stage
from quire.llm.vec import _BASE, BYTE, U, mix, powers

LENGTH, GRAM = 100, 32
#: Bytes of text in a block, in a piece that is worked on at once, and in a bucket of texts.
BLOCK, PIECE, TEXTS = 4_000_000, 500_000, 1_000_000
#: Segments in a bucket; one in so many contents is counted; contents of an anchor from which it is hot.
SEGMENTS, REPORT, HOT = 400_000, 8, 2000
#: Hot anchors that pass the driver and travel with the tasks at most, 8 bytes each.
CARRIED = 500_000
LAST = np.int64(2**63 - 1)
_INVERSE = pow(_BASE, -1, 2**64)
_OTHER = 0xD6E8FEB86659FD93
_OTHER_INVERSE = pow(_OTHER, -1, 2**64)
OTHER_BYTE = mix(BYTE)
I4, I8, U1 = np.dtype("<i4"), np.dtype("<i8"), np.dtype("u1")


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of width values from each place on."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def segments(data: np.ndarray, bounds: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start (in the text), run, anchor and content hash of the segments, in order of place."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(U), none.astype(U)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE[data] * powers(n), out=total[1:])
    back = powers(n + 1, _INVERSE)
    gram = mix((total[GRAM:] - total[:-GRAM]) * back[: n + 1 - GRAM])
    low = U((1 << n.bit_length()) - 1)
    # the place in the low bits: of equal hashes the first, which is at the same offset in equal windows
    place = (_least(gram & ~low | np.arange(len(gram), dtype=U), LENGTH - GRAM + 1) & low).astype(np.int64)
    size = np.diff(bounds)
    ends = np.repeat(bounds[1:], size)[: len(place)]
    valid = np.arange(len(place)) + LENGTH <= ends
    new = valid.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~valid[:-1] | (ends[1:] != ends[:-1])
    start = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]])) + 1
    run = stop - start
    anchor = mix(gram[place[start]])  # least hashes are small numbers; buckets are even ranges
    often = np.isin(anchor, hot) if len(hot) else np.zeros(len(anchor), bool)
    if often.any():
        pieces = np.where(often, run, 1)
        of = np.repeat(np.arange(len(start)), pieces)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        anchor, often, start = anchor[of], often[of], start[of] + inside
        run = np.where(often, 1, run[of])
    byte_end = start + run + LENGTH - 1
    content = mix((total[byte_end] - total[start]) * back[start] + run.astype(U))
    if often.any():  # of a hot anchor: the window itself, by a hash that has nothing to do with the first
        np.cumsum(OTHER_BYTE[data] * powers(n, _OTHER), out=total[1:])
        other = (total[byte_end[often]] - total[start[often]]) * powers(n + 1, _OTHER_INVERSE)[start[often]]
        anchor[often] = mix(other)
    text = np.searchsorted(bounds, start, "right") - 1
    return text, start - bounds[text], run, anchor, content


class _Texts:
    """The texts of a block and their segments."""

    def __init__(self, row: dict, hot: np.ndarray):
        self.doc_ids = np.array([LAST if x is None else x for x in row["doc_ids"]], np.int64)
        self.keys = np.array(row["text_keys"], np.int64)
        self.data = np.frombuffer(_unzip(row["texts"], U1), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])
        if row.get("hot") is not None:
            hot = np.array(row["hot"], np.int64).view(U)
        found, a = [], 0
        while a < len(self.doc_ids):
            b = max(a + 1, int(np.searchsorted(self.bounds, self.bounds[a] + PIECE, "right")) - 1)
            text, *rest = segments(self.data[self.bounds[a] : self.bounds[b]], self.bounds[a : b + 1] - self.bounds[a], hot)
            found.append((text + a, *rest))
            a = b
        self.text, self.start, self.run, self.anchor, self.content = (np.concatenate(x) for x in zip(*found, strict=True))
        # of equal (anchor, content), the first place; the rest are not asked for
        order = np.lexsort((self.start, self.keys[self.text], self.doc_ids[self.text], self.content, self.anchor))
        same = np.zeros(len(order), bool)
        same[1:] = (self.anchor[order][1:] == self.anchor[order][:-1]) & (self.content[order][1:] == self.content[order][:-1])
        lead = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
        equal = np.ones(len(order), bool)  # the same place of an equal row is as early
        for x in (self.doc_ids[self.text], self.keys[self.text], self.start):
            equal &= x[order] == x[lead]
        self.later = np.zeros(len(order), bool)
        self.later[order[same & ~equal]] = True
        self.lead = np.empty(len(order), np.int64)
        self.lead[order] = lead
        self.asked = np.sort(order[~same])
        self.buckets: dict[int, np.ndarray] = {}

    def deal(self, places: np.ndarray, n_buckets: int) -> dict[int, np.ndarray]:
        bucket = (((self.anchor[places] >> U(32)) * U(n_buckets)) >> U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        edge = [*first.tolist(), len(order)]
        return {k: places[order[x:y]] for k, x, y in zip(names.tolist(), edge[:-1], edge[1:], strict=True)}

    def at(self, some: np.ndarray) -> dict[str, bytes]:
        t = self.text[some]
        return {"doc_ids": _zip(self.doc_ids[t].astype(I8)), "text_keys": _zip(self.keys[t].astype(I8)), "starts": _zip(self.start[some].astype(I4)), "runs": _zip(self.run[some].astype(U1))}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


BLOCKS = "block bigint, doc_ids array<bigint>, text_keys array<bigint>, lengths array<int>, texts binary, n_bytes bigint, anchors array<bigint>, contents array<bigint>"


def _blocks(size: int, report: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = _schema(BLOCKS)
        number, parts, held = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            raw = b"".join(p[2] for p in parts)
            row = {"block": number, "doc_ids": [p[0] for p in parts], "text_keys": [p[1] for p in parts], "lengths": [len(p[2]) for p in parts], "texts": _zip(np.frombuffer(raw, np.uint8)), "n_bytes": len(raw)}
            t = _Texts(row, np.zeros(0, U))
            some = t.asked[t.content[t.asked] % U(report) == 0]
            row |= {"anchors": t.anchor[some].view(np.int64).tolist(), "contents": t.content[some].view(np.int64).tolist()}
            return _rows([row], schema)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for doc_id, key, text in zip(*(some.column(c).to_pylist() for c in range(3)), strict=True):
                    raw = text or b""
                    if held and held + len(raw) > size:
                        yield flush()
                        number, held = number + 1, 0
                        parts.clear()
                    parts.append((doc_id, key, raw))
                    held += len(raw)
        if parts:
            yield flush()

    return task


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            own = np.unique(_Texts(row, np.zeros(0, U)).anchor).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row["block"])), pa.array(own)], names=["block", "anchor"])


ASK = "bucket int, block bigint, anchors binary, contents binary, doc_ids binary, text_keys binary, starts binary, runs binary"


def _ask(n_buckets: int, hot: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(ASK)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = _Texts(row, hot)
                for bucket, some in t.deal(t.asked, n_buckets).items():
                    yield _rows([{"bucket": bucket, "block": row["block"], "anchors": t.anchor[some].tobytes(), "contents": t.content[some].tobytes(), **t.at(some)}], schema)

    return task


TELL = "block bigint, bucket int, answers binary, n_bytes bigint"


def _places(rows: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([_unzip(r[c], k) for r in rows]).astype(np.int64) for c, k in (("doc_ids", I8), ("text_keys", I8), ("starts", I4), ("runs", U1)))


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers: 1 if the content stands earlier, 2 if its anchor has other contents too."""
    schema = _schema(TELL)
    for rows in _groups(batches):
        anchor = np.concatenate([np.frombuffer(r["anchors"], "<u8") for r in rows])
        content = np.concatenate([np.frombuffer(r["contents"], "<u8") for r in rows])
        doc, key, start, run = _places(rows)
        order = np.lexsort((start, key, doc, content, anchor))
        a, c = anchor[order], content[order]
        new_anchor, new = np.ones(len(a), bool), np.ones(len(a), bool)
        new_anchor[1:] = a[1:] != a[:-1]
        new[1:] = new_anchor[1:] | (c[1:] != c[:-1])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        equal = (doc[order] == doc[lead]) & (key[order] == key[lead]) & (start[order] == start[lead])
        of = np.cumsum(new_anchor) - 1
        several = np.bincount(of[new])[of] > 1
        answer = np.zeros(len(a), np.uint8)
        answer[order] = np.where(equal, np.where(several, 2, 0), 1)
        n_bytes = np.where(answer == 2, run + LENGTH - 1, 0)
        edge = np.cumsum([0, *(len(r["anchors"]) // 8 for r in rows)])
        yield _rows([{"block": r["block"], "bucket": r["bucket"], "answers": _zip(answer[x:y]), "n_bytes": int(n_bytes[x:y].sum())} for r, x, y in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True)], schema)


def _answers(rows: list[dict], kind: int, asked: dict[int, np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint8)
    for r in rows:
        if r["kind"] == kind:
            out[asked[r["bucket"]]] = _unzip(r["answers"], U1)
    return out


SEND = "bucket int, block bigint, doc_ids binary, text_keys binary, starts binary, runs binary, texts binary"


def _send(n_buckets: int, n_texts: int, hot: np.ndarray):
    """A block's first occurrences whose anchors have several contents, as texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(SEND)
        for rows in _groups(batches):
            t = _Texts(rows[0], hot)
            answer = _answers(rows, 1, t.deal(t.asked, n_buckets), len(t.text))
            for bucket, some in t.deal(np.flatnonzero(answer == 2), n_texts).items():
                begin = t.bounds[t.text[some]] + t.start[some]
                size = t.run[some] + LENGTH - 1
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
                yield _rows([{"bucket": bucket, "block": rows[0]["block"], **t.at(some), "texts": _zip(t.data[place])}], schema)

    return task


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers: a bit for every window, set if it stands earlier."""
    schema = _schema(TELL)
    for rows in _groups(batches):
        doc, key, start, run = _places(rows)
        data = np.concatenate([_unzip(r["texts"], U1) for r in rows])
        at = np.concatenate([[0], np.cumsum(run + LENGTH - 1)])
        group = bwt.common([data[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], LENGTH)
        of = np.repeat(np.arange(len(run)), run)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(run) - run, run)
        group = group[at[of] + inside]
        where = start[of] + inside
        order = np.lexsort((where, key[of], doc[of], group))
        g = group[order]
        new = np.ones(len(g), bool)
        new[1:] = g[1:] != g[:-1]
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
        later = np.zeros(len(g), bool)
        later[order] = (doc[of[order]] != doc[of[lead]]) | (key[of[order]] != key[of[lead]]) | (where[order] != where[lead])
        edge = np.concatenate([[0], np.cumsum([len(_unzip(r["runs"], U1)) for r in rows])])
        first = np.concatenate([[0], np.cumsum(run)])
        yield _rows([{"block": r["block"], "bucket": r["bucket"], "answers": _zip(np.packbits(later[first[x] : first[y]])), "n_bytes": 0} for r, x, y in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True)], schema)


CUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(n_buckets: int, n_texts: int, hot: np.ndarray, keep: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(CUT if keep else CUT.replace("kept binary", "kept_sha256 binary"))
        for rows in _groups(batches):
            t = _Texts(rows[0], hot)
            answer = _answers(rows, 1, t.deal(t.asked, n_buckets), len(t.text))
            begin = t.bounds[t.text] + t.start
            whole = t.later | (answer[t.lead] == 1)
            edge = np.zeros(len(t.data) + 1, np.int32)
            np.add.at(edge, begin[whole], 1)
            np.add.at(edge, begin[whole] + t.run[whole] + LENGTH - 1, -1)
            sent = t.deal(np.flatnonzero(answer == 2), n_texts)
            bits = {}
            for r in rows:
                if r["kind"] == 2:
                    some = sent[r["bucket"]]
                    run = t.run[some]
                    of = np.repeat(np.arange(len(some)), run)
                    inside = np.arange(len(of)) - np.repeat(np.cumsum(run) - run, run)
                    hit = np.unpackbits(_unzip(r["answers"], U1), count=len(of)).astype(bool)
                    windows = begin[some][of[hit]] + inside[hit]
                    np.add.at(edge, windows, 1)
                    np.add.at(edge, windows + LENGTH, -1)
                    for s, x, y in zip(some.tolist(), (np.cumsum(run) - run).tolist(), np.cumsum(run).tolist(), strict=True):
                        bits[s] = hit[x:y]
            # what was asked for once holds for the same place of an equal row in this block
            for s in np.flatnonzero(~t.later & (t.lead != np.arange(len(t.lead)))).tolist():
                if (hit := bits.get(int(t.lead[s]))) is not None:
                    windows = begin[s] + np.flatnonzero(hit)
                    np.add.at(edge, windows, 1)
                    np.add.at(edge, windows + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            inner = t.bounds[:-1][t.bounds[:-1] < len(gone)]
            first[inner] = gone[inner]
            count = lambda x: (c := np.concatenate([[0], np.cumsum(x, dtype=np.int64)]))[t.bounds[1:]] - c[t.bounds[:-1]]
            removed, spans = count(gone), count(first)
            kept = []
            for a, b, n in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), removed.tolist(), strict=True):
                raw = t.data[a:b].tobytes() if not n else t.data[a:b][~gone[a:b]].tobytes()
                kept.append(raw if keep else hashlib.sha256(raw).hexdigest().encode())
            ids = pa.array([None if x == LAST else x for x in t.doc_ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(t.bounds)), pa.array(removed), pa.array(spans), pa.array(kept, pa.binary())], schema=schema)

    return task


def remove_repeats(docs: DataFrame, *, keep: bool = True, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document; with
    ``keep=False``, kept_sha256 instead of the bytes."""
    spark = docs.sparkSession
    tasks = parallelism(spark)
    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text.alias("text"))
    blocks = stage(rows.mapInArrow(_blocks(block, REPORT), BLOCKS), "repeat-blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(tasks, n_bytes // (SEGMENTS * (LENGTH - GRAM + 2) // 2))
    counted = blocks.select(F.explode(F.arrays_zip("anchors", "contents")).alias("x")).select("x.anchors", "x.contents").distinct()
    often = counted.groupBy("anchors").count().where(F.col("count") * REPORT > HOT)
    often = stage(often.select("anchors"), "repeat-hot")
    sides = blocks.select("block", "doc_ids", "text_keys", "lengths", "texts")
    if often.count() <= CARRIED:
        hot = np.sort(np.array([r.anchors for r in often.collect()], np.int64).view(U))
        sides = sides.withColumn("hot", F.lit(None).cast("array<bigint>"))
    else:
        hot = np.zeros(0, U)
        held = sides.mapInArrow(_anchors, "block bigint, anchor bigint").join(often, F.col("anchor") == F.col("anchors"))
        held = held.groupBy("block").agg(F.collect_list("anchor").alias("hot"))
        sides = stage(sides.join(held, "block", "left"), "repeat-sides")
    asked = sides.mapInArrow(_ask(n_buckets, hot), ASK).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    told = stage(asked.mapInArrow(_tell, TELL), "repeat-told")
    n_texts = max(tasks, (told.agg(F.sum("n_bytes")).first()[0] or 0) // TEXTS)

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<bigint>"), ("text_keys", "array<bigint>"), ("lengths", "array<int>"), ("texts", "binary"), ("hot", "array<bigint>"))]
    own = sides.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("answers"), "doc_ids", "text_keys", "lengths", "texts", "hot")
    first = told.select("block", F.lit(1).alias("kind"), "bucket", "answers", *nothing)
    met = own.unionByName(first).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    sent = met.mapInArrow(_send(n_buckets, n_texts, hot), SEND).repartition(max(tasks, n_texts), "bucket").sortWithinPartitions("bucket")
    matched = stage(sent.mapInArrow(_match, TELL), "repeat-matched")
    second = matched.select("block", F.lit(2).alias("kind"), "bucket", "answers", *nothing)
    met = own.unionByName(first).unionByName(second).repartition(tasks, "block").sortWithinPartitions("block", "kind")
    out = met.mapInArrow(_cut(n_buckets, n_texts, hot, keep), CUT if keep else CUT.replace("kept binary", "kept_sha256 binary"))
    return out if keep else out.withColumn("kept_sha256", F.col("kept_sha256").cast("string"))
