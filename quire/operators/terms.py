"""Terms in texts by Aho-Corasick automata: one pass over the texts finds all terms of a block.

A few terms are tests of their own in the row, which Spark compiles. More are cut into blocks of at most ``BLOCK``
terms, by hash; a block's automaton is a broadcast of bounded size, which each task runs once over each of its
texts, whatever the number of terms. Cases are folded by Spark on both sides.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that are looked for in the row, and those of one automaton: tens of MB.
FEW, BLOCK = 200, 100_000


def automaton(values: dict[str, object]):
    """Of the strings of a dict; what it finds is their values."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, value in values.items():
        found.add_word(word, value)
    found.make_automaton()
    return found


def blocks(terms: DataFrame, n: int) -> Iterator[list]:
    """The rows (low, ...) of each block: all of one folded term in the same."""
    many = -(-n // BLOCK)
    for k in range(many):
        yield terms.where(F.pmod(F.xxhash64("low"), F.lit(many)) == k).collect() if many > 1 else terms.collect()


def hits(texts: DataFrame, keys: list[str], rows: list) -> DataFrame:
    """``keys`` and the term (``term``) of each text (``low``) and each of the rows (low, term) that occurs in it, once."""
    of: dict[str, list[str]] = {}
    for r in rows:
        of.setdefault(r.low, []).append(r.term)
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(automaton(of)))
    fields = [f for f in texts.schema.fields if f.name in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(sent.value)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("low").to_pylist()):
                if text:
                    for word in {id(v): v for _, v in machine.iter(text)}.values():
                        at += [i] * len(word)
                        found += word
            taken = batch.select([f.name for f in fields]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], [*taken.schema.names, "term"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return texts.select(*[f.name for f in fields], "low").mapInArrow(run, f"{kind}, term string")


def misses(texts: DataFrame, rows: list) -> DataFrame:
    """``segment_id, n``: how many of the rows (low, term, target) have their term in the text (``low``) and not their target in the
    translation, where any do."""
    of: dict[str, list[str]] = {}
    for r in rows:
        of.setdefault(r.low, []).append(r.target)
    sent = texts.sparkSession.sparkContext.broadcast(pickle.dumps(automaton(of)))
    kind = texts.schema["segment_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(sent.value)
        for batch in batches:
            counts = []
            for text, told in zip(batch.column("low").to_pylist(), batch.column("translated_text").to_pylist(), strict=True):
                words = {id(v): v for _, v in machine.iter(text)}.values() if text else ()
                counts.append(sum(t not in told for w in words for t in w))
            n = pa.array(counts, pa.int64())
            some = pa.array([i for i, c in enumerate(counts) if c], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("segment_id").take(some), n.take(some)], ["segment_id", "n"])

    return texts.select("segment_id", "low", "translated_text").mapInArrow(run, f"segment_id {kind}, n long")
