"""Harmonic packing of documents into fixed-length sequences."""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions, query, shipped, table
from .tokens import default_path, encoder

CAPACITY = 4096
CLASSES = 64
END = 2
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"


class Harmonic:
    """Bounded-space packing: class k takes pieces of (capacity/(k+1), capacity/k] ids, k to a bin.

    A document of more than ``capacity`` ids fills whole sequences first; its rest has a class. A
    full bin's gap is filled from the head of the next document, so closed sequences hold exactly
    ``capacity`` ids. What is open at the end is laid end to end into full sequences, and the last
    few ids into sequences of powers of two, which need no padding.
    """

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.bins: dict[int, list] = {}
        self.used: dict[int, int] = {}
        self.short: deque = deque()  # closed bins that still have a gap

    def add(self, doc, ids: np.ndarray):
        """Take one document; yields the sequences this completes, as lists of (doc, start, ids, total)."""
        total, at = len(ids), 0
        while self.short and at < total:
            bin_, gap = self.short[0]
            take = min(gap, total - at)
            bin_.append((doc, at, ids[at : at + take], total))
            at += take
            if take == gap:
                self.short.popleft()
                yield bin_
            else:
                self.short[0] = (bin_, gap - take)
        while total - at >= self.capacity:
            yield [(doc, at, ids[at : at + self.capacity], total)]
            at += self.capacity
        rest = total - at
        if not rest:
            return
        kind = min(self.capacity // rest, self.classes)
        bin_ = self.bins.setdefault(kind, [])
        if kind == self.classes and self.used.get(kind, 0) + rest > self.capacity:
            # the class of the smallest pieces is filled to the brim instead of by number
            take = self.capacity - self.used[kind]
            if take:
                bin_.append((doc, at, ids[at : at + take], total))
            yield self.bins.pop(kind)
            self.bins[kind], self.used[kind] = [(doc, at + take, ids[at + take :], total)], rest - take
            return
        bin_.append((doc, at, ids[at:], total))
        self.used[kind] = self.used.get(kind, 0) + rest
        if kind < self.classes and len(bin_) == kind:
            gap = self.capacity - self.used.pop(kind)
            del self.bins[kind]
            if gap:
                self.short.append((bin_, gap))
            else:
                yield bin_

    def finish(self):
        """Yield what is left: full sequences, then sequences of powers of two."""
        pieces = [p for bin_, _ in self.short for p in bin_] + [p for k in sorted(self.bins) for p in self.bins[k]]
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            out = []
            while size:
                doc, at, ids, total = pieces.pop()
                if len(ids) > size:
                    pieces.append((doc, at + size, ids[size:], total))
                    ids = ids[:size]
                out.append((doc, at, ids, total))
                size -= len(ids)
            yield out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, classes: int = CLASSES, end: int = END) -> DataFrame:
    """Encode ``text`` of every row, append ``end`` and pack: one row per piece of a document.

    Every input split is packed by itself as its rows stream by, holding at most one open bin per
    class, so nothing is shuffled and no group of documents meets in one task; a lost task packs the
    same split again. ``ids`` are the piece's ids as little-endian unsigned 32-bit values, and
    ``padded_length`` is the capacity or the sequence's own length, a power of two.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed as often
    as they occur; a very long text fills sequences alone; an empty table gives no rows; extra columns are not read.
    """
    path = path or default_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tool = encoder(path)
        packer = Harmonic(capacity, classes)
        number = TaskContext.get().partitionId() << 33
        rows: list = []
        size = 0

        def flush():
            columns = list(zip(*rows))
            types = [pa.int64()] * 7 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "padded_length", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def place(sequence):
            nonlocal number, size
            offset, full = 0, sum(len(p[2]) for p in sequence)
            padded = full if full & (full - 1) == 0 else capacity
            for doc, at, ids, total in sequence:
                rows.append((doc, at, len(ids), total, number, offset, padded, ids.astype("<u4").tobytes()))
                offset += len(ids)
            number += 1
            size += full

        for batch in itertools.chain.from_iterable(portions(whole, 1) for whole in batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tool.encode(text)
                for sequence in packer.add(doc, np.append(ids, ids.dtype.type(end))):
                    place(sequence)
                if size >= 1 << 21:
                    yield flush()
                    rows.clear()
                    size = 0
        for sequence in packer.finish():
            place(sequence)
        if rows:
            yield flush()
        tool.forget()

    return shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


@query("op3_harmonic_packing")
def op3(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
