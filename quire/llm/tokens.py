"""Token ids in a binary format with random access: directly addressable codes.

Documents are range-sorted by id, encoded, and written in shards of at most ``SHARD`` ids (a longer
document has a shard of its own). A shard's ids are split into 8-bit chunks. Level 0 holds the lowest
chunk of every id; a bitmap tells which ids go on, and only those have a chunk in level 1, and so on.
A rank directory (ones before every 512 bits) leads from a place in one level to its place in the next,
so that any token is read from a few bytes without decoding a block (``Ranges``, ``token``).

A file is shards one after another, each closed by a newline, uncompressed, written by Spark's own writer:
any store that Spark reaches will do, a task that is run twice leaves one copy, and a place in a file is
a place in its bytes. ``SHARDS`` shards make a file at most. Files are named in order of documents. All
numbers are little-endian:

    header   magic DAC1, u4 levels, u4 documents, u8 ids, u8 bytes of the shard without the newline
    levels   u8 places, of each level
    chunks   u1 a place; bitmap, u1 for 8 places; directory, u4 for 512 places; of each level
    table    i8 document ids, u4 lengths in ids (end id included), u1 whether the id is there

Encoding is exact: where a tokenizer's tokens hold no white space and don't depend on what stands across
it (probed when it is loaded), a text's ids are those of its pieces between spaces and newlines; other
tokenizers get whole texts. Pieces that a worker has met are kept in bounded arrays; new ones are encoded
together. Texts are taken ``CHUNK`` bytes at a time, a longer one in parts cut at spaces.

Defined results: null and empty texts have the end id only; documents of equal id are in order of their
text; null ids come first; equal rows are documents of their own; extra columns are ignored; an empty
table gives no shard.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.store import new_path, parallelism, small_batches, stage
from quire.llm.vec import CHUNK, chunks, column, hashes, release, runs

SHARD, SHARDS = 250_000, 64
END_ID = 2
BLOCK = 512
#: Pieces kept by a worker: at most some 100 MB.
KEPT = 2_000_000
MARK = "\x01"
MAGIC = b"DAC1"
HEAD = 24


# -- the code ---------------------------------------------------------------------------------------


def pack(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard of unsigned 32-bit ids."""
    sizes, body, rest = [], [], ids.astype(np.uint32)
    while len(rest):
        more = rest > 0xFF
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(blocks[:-1], dtype=np.uint32)]).astype("<u4")
        sizes.append(len(rest))
        body += [(rest & 0xFF).astype(np.uint8).tobytes(), np.packbits(more, bitorder="little").tobytes(), rank.tobytes()]
        rest = rest[more] >> 8
    there = np.array([x is not None for x in doc_ids], np.uint8)
    table = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u4").tobytes(), there.tobytes()]
    rest_bytes = np.array(sizes, "<u8").tobytes() + b"".join(body + table)
    counts = np.array([len(sizes), len(doc_ids)], "<u4").tobytes() + np.array([len(ids), HEAD + 4 + len(rest_bytes)], "<u8").tobytes()
    return MAGIC + counts + rest_bytes


def _places(sizes: list[int], at: int) -> list[tuple[int, int, int]]:
    """Where each level's chunks, bitmap and directory begin, and where the table does."""
    out = []
    for n in sizes:
        more = at + n
        rank = more + -(-n // 8)
        out.append((at, more, rank))
        at = rank + 4 * -(-n // BLOCK)
    return [*out, (at, at, at)]


class Shard:
    """A shard that is in memory as a whole, at a place of a file's bytes."""

    def __init__(self, raw: memoryview, at: int = 0):
        if raw[at : at + 4] != MAGIC:
            raise ValueError("not a shard")
        n_levels, n_docs = np.frombuffer(raw, "<u4", 2, at + 4).tolist()
        self.n_ids, size = np.frombuffer(raw, "<u8", 2, at + 12).tolist()
        self.end = at + size
        self.sizes = np.frombuffer(raw, "<u8", n_levels, at + HEAD + 4).tolist()
        self.places = _places(self.sizes, at + HEAD + 4 + 8 * n_levels)
        table = self.places[-1][0]
        there = np.frombuffer(raw, np.uint8, n_docs, table + 12 * n_docs)
        self.doc_ids = [d if t else None for d, t in zip(np.frombuffer(raw, "<i8", n_docs, table).tolist(), there.tolist(), strict=True)]
        self.lengths = np.frombuffer(raw, "<u4", n_docs, table + 8 * n_docs).astype(np.int64)
        self.raw = raw

    def ids(self) -> np.ndarray:
        out = np.zeros(0, "<u4")
        for n, (chunk, more, _) in reversed(list(zip(self.sizes, self.places[:-1], strict=True))):
            whole = np.frombuffer(self.raw, np.uint8, n, chunk).astype("<u4")
            whole[np.flatnonzero(np.unpackbits(np.frombuffer(self.raw, np.uint8, -(-n // 8), more), count=n, bitorder="little"))] |= out << 8
            out = whole
        return out


def shards(raw: memoryview) -> Iterator[tuple[int, Shard]]:
    """Places and shards of a file's bytes."""
    at = 0
    while at < len(raw):
        one = Shard(raw, at)
        yield at, one
        at = one.end + 1


class Ranges:
    """Tokens of a file by ranges of its bytes: what is read doesn't grow with the file or the shard."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
        self.file = self.store.open_input_file(path)
        self.n_read = 0

    def bytes(self, at: int, n: int) -> bytes:
        self.n_read += n
        return self.file.read_at(n, at)

    def token(self, shard_at: int, i: int) -> int:
        """The id at place i of the shard: a byte, a bit's block and a directory entry of each level."""
        head = self.bytes(shard_at, HEAD + 4)
        if head[:4] != MAGIC:
            raise ValueError("not a shard")
        if not 0 <= i < int.from_bytes(head[12:20], "little"):
            raise IndexError(i)
        n_levels = int.from_bytes(head[4:8], "little")
        sizes = np.frombuffer(self.bytes(shard_at + HEAD + 4, 8 * n_levels), "<u8").tolist()
        value = 0
        for depth, (chunk, more, rank) in enumerate(_places(sizes, shard_at + HEAD + 4 + 8 * n_levels)[:-1]):
            value |= self.bytes(chunk + i, 1)[0] << 8 * depth
            block, inside = divmod(i, BLOCK)
            bits = int.from_bytes(self.bytes(more + block * BLOCK // 8, inside // 8 + 1), "little")
            if not bits >> inside & 1:
                break
            i = int.from_bytes(self.bytes(rank + 4 * block, 4), "little") + (bits & ((1 << inside) - 1)).bit_count()
        return value


# -- encoding ---------------------------------------------------------------------------------------

_encoders: dict = {}
PROBES = ("a b", " a  b ", "don't stop\nnow 12 x.y", "a\n\nb", "é ü — 中文 ok", "(a) b's, c!")


class _Pieces:
    """Ids of pieces of text that a worker has met, in arrays: some 40 bytes a piece. The half that was used last stays
    when there are too many. Pieces are told apart by 64 bits of hash and their length."""

    def __init__(self):
        self.h, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.n, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.end, self.time = np.zeros(1 << 16, "<u4"), 0, 0

    def find(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of pieces, -1 of those that aren't known."""
        if not len(self.h):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        self.time += 1
        there = (self.h[i] == h) & (self.size[i] == size)
        self.used[i[there]] = self.time
        return np.where(there, i, -1)

    def add(self, h: np.ndarray, size: np.ndarray, ids: list[bytes]) -> None:
        """New pieces, by rising hash; of two with one hash the later is forgotten again."""
        n = np.array([len(x) // 4 for x in ids], np.int64)
        more = np.frombuffer(b"".join(ids), "<u4")
        while self.end + len(more) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), "<u4")])
        self.pool[self.end : self.end + len(more)] = more
        at = self.end + np.cumsum(n) - n
        self.end += len(more)
        place = np.searchsorted(self.h, h)
        put = lambda old, new: np.insert(old, place, new)
        self.h, self.size, self.at, self.n, self.used = put(self.h, h), put(self.size, size), put(self.at, at), put(self.n, n), put(self.used, self.time)

    def forget(self) -> None:
        """Down to half of KEPT, those used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: KEPT // 2])
        ids, _ = self.ids(keep)
        self.h, self.size, self.n, self.used = self.h[keep], self.size[keep], self.n[keep], self.used[keep]
        self.at = np.cumsum(self.n) - self.n
        self.pool, self.end = np.concatenate([ids, np.zeros(1 << 16, "<u4")]), len(ids)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        n = self.n[places]
        upto = np.cumsum(n)
        return self.pool[np.arange(upto[-1] if len(n) else 0) + np.repeat(self.at[places] - (upto - n), n)], n


class _Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = _Pieces()
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.by_piece = all(ids(t) == [i for p in t.replace("\n", " ").split(" ") for i in ids(p)] for t in PROBES)
        mark = ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text data[bounds[i]:bounds[i + 1]] of UTF-8 bytes; bounds start at 0."""
        if not self.by_piece:
            return [np.frombuffer(self._ids(str(memoryview(data[a:b]), "utf-8")), "<u4") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        starts, ends = runs((data != 0x20) & (data != 0x0A), bounds)
        h, first, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        size = ends[first] - starts[first]
        place = self.known.find(h, size)
        new = np.flatnonzero(place < 0)
        if len(new):
            view = memoryview(data)
            pieces = [str(view[a:b], "utf-8") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            self.known.add(h[new], size[new], self._new(pieces))
            place = self.known.find(h, size)
        ids, n = self.known.ids(place[which])
        upto = np.append(0, np.cumsum(n))[np.searchsorted(starts, bounds)]
        if len(self.known.h) > KEPT:
            self.known.forget()
        return [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, new: list[str], group: int = 500) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(new), group):
            some = new[a : a + group]
            if self.mark is not None and not any(MARK in p for p in some):
                ids = np.array(self.tokenizer.encode(f" {MARK} ".join(some), add_special_tokens=False).ids, "<u4")
                cut = np.flatnonzero(ids == self.mark)
                if len(cut) == len(some) - 1:
                    edge = np.concatenate([[-1], cut, [len(ids)]])
                    raw = ids.tobytes()
                    out.extend(raw[4 * (x + 1) : 4 * y] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                    continue
            out.extend(map(self._ids, some))
        return out

    def encode_long(self, raw: memoryview | np.ndarray) -> np.ndarray:
        """Ids of one long text of UTF-8 bytes, in parts that end at a space."""
        data = np.frombuffer(raw, np.uint8)
        out, a, n = [np.zeros(0, "<u4")], 0, len(data)
        while a < n:
            b = n
            if self.by_piece and n - a > CHUNK:
                b = data[a : a + CHUNK].tobytes().rfind(b" ") + a + 1
                if b == a:  # no space so near: on to the next one
                    rest = data[a:].tobytes()
                    b = a + (rest.find(b" ") + 1 or len(rest))
            out.append(self.encode(data[a:b], np.array([0, b - a]))[0])
            a = b
        return np.concatenate(out)


def encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def _writer(path: str, end_id: int, shard_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4")
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        raw: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack(np.concatenate(raw), doc_ids, lengths)], pa.binary())], names=["shard"])

        for batch in batches:
            data, offsets = column(batch.column(1))
            for a, b in chunks(offsets):
                text = data[offsets[a] : offsets[b]]
                found = [enc.encode_long(text)] if len(text) > CHUNK else enc.encode(text, offsets[a : b + 1] - offsets[a])
                for doc_id, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), found, strict=True):
                    n = len(ids) + 1
                    if held and held + n > shard_ids:
                        yield flush()
                        held = 0
                        doc_ids.clear(), lengths.clear(), raw.clear()
                    doc_ids.append(doc_id), lengths.append(n), raw.extend((ids.copy(), end))
                    held += n
        if doc_ids:
            yield flush()
        release()

    return write


def write(docs: DataFrame, tokenizer: str, *, path: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD, shards_a_file: int = SHARDS) -> str:
    """Encode docs (doc_id, text) and write the files; gives their path."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    shard = rows.mapInArrow(_writer(tokenizer, end_id, shard_ids), "shard binary").select(F.col("shard").cast("string"))
    with small_batches(spark):
        shard.write.option("maxRecordsPerFile", shards_a_file).option("compression", "none").text(path)
    return path


# -- reading ----------------------------------------------------------------------------------------

ROWS = "file string, shard_at bigint, inside bigint, before bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint"


def _reader(with_ids: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, before = batch.column(0)[i].as_py(), 0
                for at, shard in shards(memoryview(batch.column(1)[i].as_buffer())):
                    ids, n = shard.ids(), len(shard.doc_ids)
                    ends = np.cumsum(shard.lengths)
                    starts = ends - shard.lengths
                    raw = memoryview(ids.tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    columns = [pa.array([name] * n), pa.array([at] * n), pa.array(starts), pa.array(starts + before), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.lengths), pa.array(crc, pa.int64())]
                    names = [x.split()[0] for x in ROWS.split(", ")]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64))))
                        names.append("ids")
                    before += shard.n_ids
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    return read


def _documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_reader(with_ids), ROWS + (", ids array<bigint>" if with_ids else ""))


def read(spark: SparkSession, path: str, *, with_ids: bool = False) -> DataFrame:
    """One row a document from the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 and, if asked for, ids. Starts come from a running sum over the files' counts, one row a file."""
    docs = stage(_documents(spark, path), "token-rows")
    name = F.regexp_extract("file", r"part-(\d+)[^/]*-c(\d+)[^/]*$", 1).cast("int"), F.regexp_extract("file", r"part-(\d+)[^/]*-c(\d+)[^/]*$", 2).cast("int")
    earlier = Window.orderBy("part", "c").rowsBetween(Window.unboundedPreceding, -1)
    files = docs.groupBy("file").agg(F.sum("n_tokens").alias("s")).select("file", "s", name[0].alias("part"), name[1].alias("c"))
    files = files.select("file", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("of_file"))
    if with_ids:
        docs = _documents(spark, path, True)
    out = docs.join(files, "file")
    return out.select("doc_id", (F.col("of_file") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Where each document stands: doc_id, file, shard_at (byte of its shard), inside (its first place
    in the shard) and n_tokens, written once, in order of doc_id."""
    rows = _documents(spark, path).select("doc_id", "file", "shard_at", "inside", "n_tokens")
    return stage(rows.sortWithinPartitions("doc_id"), "token-index")


def token(places: DataFrame, doc_id: int, i: int) -> int:
    """Token i of a document, by its row of the index and a few ranges of its file's bytes."""
    row = places.where(F.col("doc_id") == doc_id).first()
    if row is None or not 0 <= i < row.n_tokens:
        raise IndexError(f"{doc_id}: {i}")
    return Ranges(row.file).token(row.shard_at, row.inside + i)
