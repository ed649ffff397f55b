"""Language-model scoring by a weighted backoff automaton.

The model is an interpolated trigram model over add-one-tenth unigrams. As an automaton: the root state has
an arc for every word, weighted by its unigram log-probability. Every word seen in training (and the start
of a text), and every two of them in a row, is a state h with an arc for every word w seen after it,
weighted log10((c(h,w) + back(h) * p(w)) / (c(h) + back(h))), where p(w) is the probability in the state
that h fails to; and a failure arc to the state of one word less, in the end the root, weighted
log10(back(h) / (c(h) + back(h))). back(h) = c(h) ** HEAPS is how many different words a state of that count
is expected to see next, by Heaps' law: the weight of Witten and Bell. A text is traversed once from left to
right: in the state of the last two words, or of the last one if training has not seen the two, take the
word's arc, or else fail, adding the arc's weight, until a state has one; the word leads to the longest
state that ends in it. Scores of all continuations of a state sum to one with one slot for unknown words.

Neither the automaton nor the vocabulary is ever broadcast or held whole. Documents are gathered in blocks
(``BLOCK`` tokens). A block asks for what it needs: the counts of its distinct n-grams of one to three
words go with its own training counts to buckets by ranges of hash. Words are known by 62 bits of hash,
longer n-grams by 56: one that training has not seen is taken for one that it has with a chance of the
number of distinct n-grams in 2^56, one in 10^4 for 10^13 of them. A bucket
adds the counts up and answers each block in the block's own order, so that an answer needs no keys. What
moves is one entry for each distinct n-gram of a block, whatever the frequencies are, and no bucket is hot:
a frequent n-gram is one entry a block. Buckets are as many as keep a bucket's share of the tokens bounded
(``BUCKET``).

Defined results: null and empty texts have the end token only; a null id counts as the text '' for the
split; equal rows are separate texts; without training texts every count is 0 and each token has the
probability of an unknown word; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import parallelism, stage
from quire.llm.vec import Words, chunks, column, mix, release

#: Tokens of a block, and for each bucket.
BLOCK, BUCKET = 1_250_000, 1_000_000
ADD, HEAPS, ORDER = 0.1, 0.75, 3
U = np.uint64
END, START = (int(x) for x in mix(np.array([0xE0D, 0x57A27], U)))
U4, U8 = np.dtype("<u4"), np.dtype("<u8")
_FACTOR = U(0xD6E8FEB86659FD93)


def _zip(array: np.ndarray) -> bytes:
    """Length and compressed bytes."""
    raw = array.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes, kind: np.dtype) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], n, codec="zstd", asbytes=True), kind) if n else np.zeros(0, kind)


def _zip_planes(array: np.ndarray) -> bytes:
    """Byte by byte: high bytes that are nearly all zero take no room."""
    return _zip(np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.dtype.itemsize).T))


def _unzip_planes(raw: bytes, kind: np.dtype) -> np.ndarray:
    planes = _unzip(raw, np.dtype(np.uint8)).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _zip_sorted(keys: np.ndarray) -> bytes:
    """Differences of sorted keys."""
    return _zip_planes(np.diff(keys, prepend=U(0)).astype(U8))


def _unzip_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unzip_planes(raw, U8), dtype=U)


BLOCK_FIELDS = "block bigint, doc_ids array<bigint>, lengths array<int>, held array<boolean>, vocabulary binary, ids binary, n_train bigint"


def _blocks(size: int):
    """Texts to blocks: the sorted hashes of the block's words, and its texts as places in them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held_tokens, parts = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pa.RecordBatch:
            lengths, out = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            vocabulary, ids = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
            columns = [
                pa.array([number]),
                pa.array([[x for p in parts for x in p[0]]], pa.list_(pa.int64())),
                pa.array([lengths.tolist()], pa.list_(pa.int32())),
                pa.array([out.tolist()], pa.list_(pa.bool_())),
                pa.array([_zip_sorted(vocabulary)], pa.binary()),
                pa.array([_zip_planes(ids.astype(U4))], pa.binary()),
                pa.array([int(lengths[~out].sum())]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_ids", "lengths", "held", "vocabulary", "ids", "n_train"])

        for batch in batches:
            data, offsets = column(batch.column(2))
            out = np.array(batch.column(1).to_pylist(), bool)
            for a, b in chunks(offsets):
                w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                end = np.cumsum(w.n + 1) - 1
                tokens = np.empty(len(w.h) + b - a, U)
                is_word = np.ones(len(tokens), bool)
                is_word[end] = False
                tokens[is_word], tokens[end] = w.h, U(END)
                parts.append((batch.column(0).slice(a, b - a).to_pylist(), w.n + 1, out[a:b], tokens))
                held_tokens += len(tokens)
                if held_tokens >= size:
                    yield flush()
                    number, held_tokens = number + 1, 0
                    parts.clear()
        if parts:
            yield flush()
        release()

    return task


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the place of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(len(keys), np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], of


class _Block:
    """A block's n-grams. ``distinct``: of all orders, sorted, their low bits the order. ``at``: of each order
    and token, the place in distinct, counted from 1, of the n-gram that ends there, and 0 where the text has
    begun too late for one."""

    def __init__(self, lengths: list[int], held: list[bool], vocabulary: bytes, ids: bytes):
        word = _unzip_sorted(vocabulary)[_unzip_planes(ids, U4)]
        self.lengths = np.array(lengths, np.int64)
        self.train = np.repeat(~np.array(held, bool), self.lengths)
        self.begin = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.begin] = U(START)
        two = mix(before * _FACTOR + word)
        before[1:] = two[:-1]
        three = mix(before * _FACTOR + word) & ~U(255) | U(3)
        three[self.begin] = 0
        found = [_ranked(x) for x in (mix(word) & ~U(3) | U(1), two & ~U(255) | U(2), three)]
        every, rank = _ranked(np.concatenate([d for d, _ in found]))
        none = int(len(every) > 0 and not every[0])
        self.distinct, edge = every[none:], np.cumsum([0, *(len(d) for d, _ in found)])
        self.at = [(rank[a : a + len(d)] + 1 - none)[of] for (d, of), a in zip(found, edge[:-1].tolist(), strict=True)]

    def train_counts(self) -> np.ndarray:
        n = len(self.distinct) + 1
        return sum(np.bincount(at[self.train], minlength=n) for at in self.at)[1:]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of equal first column, which come together."""
    group: list[dict] = []
    for batch in batches:
        name = batch.schema.names[0]
        for i in range(0, batch.num_rows, 64):
            for row in batch.slice(i, 64).to_pylist():
                if group and group[0][name] != row[name]:
                    yield group
                    group = []
                group.append(row)
    if group:
        yield group


ASK = "bucket bigint, block bigint, keys binary, counts binary"
ASK_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _ask(n_buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                b = _Block(r["lengths"], r["held"], r["vocabulary"], r["ids"])
                counts = b.train_counts().astype(U4)
                names, first = np.unique(((b.distinct >> U(32)) * U(n_buckets)) >> U(32), return_index=True)
                edge = [*first.tolist(), len(counts)]
                for a in range(0, len(names), 64):
                    rows = [
                        {"bucket": int(k), "block": r["block"], "keys": _zip_sorted(b.distinct[x:y]), "counts": _zip_planes(counts[x:y])}
                        for k, x, y in zip(names[a : a + 64].tolist(), edge[:-1][a : a + 64], edge[1:][a : a + 64], strict=True)
                    ]
                    yield pa.RecordBatch.from_pylist(rows, schema=ASK_ARROW)
        release()

    return task


TELL = "block bigint, bucket bigint, counts binary, seen bigint"
TELL_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("seen", pa.int64())])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds counts up. The row with block null has the number of distinct words that training has seen."""
    for rows in _groups(batches):
        keys = [_unzip_sorted(r["keys"]) for r in rows]
        distinct, of = _ranked(np.concatenate(keys))
        total = np.bincount(of, weights=np.concatenate([_unzip_planes(r["counts"], U4) for r in rows]), minlength=len(distinct))
        out = [{"block": None, "bucket": rows[0]["bucket"], "counts": None, "seen": int(((distinct & U(3) == 1) & (total > 0)).sum())}]
        told, edge = total[of].astype(U8), np.cumsum([0, *map(len, keys)])
        out += [{"block": r["block"], "bucket": r["bucket"], "counts": _zip_planes(told[x:y].astype(U4) if told[x:y].max() < 1 << 32 else told[x:y]), "seen": y - x} for r, x, y in zip(rows, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_pylist(out, schema=TELL_ARROW)
    release()


def _told(row: dict) -> np.ndarray:
    wide = int.from_bytes(row["counts"][:8], "little") == 8 * row["seen"]
    return _unzip_planes(row["counts"], U8 if wide else U4).astype(np.float64)


def back(count: np.ndarray) -> np.ndarray:
    """How many different words a state of that count is expected to see next."""
    return count**HEAPS


def traverse(counts: list[np.ndarray], contexts: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """log10 probability of each token. counts: of the n-grams that end there, of two words on; contexts: of
    the states that they begin with; p: in the root. From the root up, each state's arc adds to the
    probability in the state that it fails to; a state that training has not seen is not there."""
    score = np.log10(p)
    for c, h in zip(counts, contexts, strict=True):
        state = h > 0
        b = back(h)
        weight = np.where(state, h + b, 1.0)
        p = np.where(state, (c + b * p) / weight, p)
        arc, fail = np.log10(p), np.log10(np.where(state, b / weight, 1.0)) + score
        score = np.where(c > 0, arc, fail)
    return score


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _traverse(n: float, v: float, texts: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            r = rows[0]
            b = _Block(r["lengths"], r["held"], r["vocabulary"], r["ids"])
            told = np.concatenate([[0.0], *(_told(x) for x in rows[1:])])
            one, two, three = (told[at] for at in b.at)
            starts = np.zeros(len(one), bool)
            starts[b.begin] = True
            shifted = lambda c, first: np.where(starts, first, np.concatenate([[0.0], c[:-1]]))
            root = (one + ADD) / (n + ADD * (v + 1))  # the root's arcs
            score = traverse([two, three], [shifted(one, texts), shifted(two, 0.0)], root)
            sums = [np.add.reduceat(x, b.begin) for x in ((one > 0).astype(np.int64), np.log10(root), score)]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(r["held"], pa.bool_()), pa.array(b.lengths), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        release()

    return task


def score(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; texts
    whose crc32(id) is a multiple of 10 are held out of training."""
    spark = docs.sparkSession
    tasks = parallelism(spark)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))
    blocks = stage(rows.mapInArrow(_blocks(block), BLOCK_FIELDS), "lm-blocks")
    texts = F.size(F.filter("held", lambda x: ~x))
    of = blocks.agg(F.sum("n_train").alias("n"), F.sum(texts).alias("texts"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("tokens")).first()
    n_buckets = max(4 * tasks, (of.tokens or 0) // BUCKET)
    tasks = max(tasks, n_buckets // 4)

    sides = blocks.select("block", "lengths", "held", "vocabulary", "ids")
    asked = sides.mapInArrow(_ask(n_buckets), ASK).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    told = stage(asked.mapInArrow(_tell, TELL), "lm-counts")
    v = told.where("block is null").agg(F.sum("seen")).first()[0] or 0

    own = blocks.select("block", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("counts"), F.lit(0).cast("long").alias("seen"), "doc_ids", "lengths", "held", "vocabulary", "ids")
    met = own.unionByName(told.where("block is not null"), allowMissingColumns=True)
    met = met.repartition(tasks, "block").sortWithinPartitions("block", "bucket")
    scored = met.mapInArrow(_traverse(float(of.n or 0), float(v), float(of.texts or 0)), SCORES)
    return scored.withColumn("train_tokens", F.lit(of.n or 0).cast("long"))


def unknown(n: float, v: float) -> float:
    """log10 probability of a word that training has not seen, in the root."""
    return math.log10(ADD / (n + ADD * (v + 1)))
