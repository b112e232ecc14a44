"""A token store: ids in the fewest bits the vocabulary needs, in blocks that are found by offset.

A store is a folder of Parquet files with one row per block, so that writing commits as Spark
commits and any file system Spark knows will do. The rows of a shard are its blocks in order:

========== ============= ==========================================================
shard      int           the writing partition; shards are in ascending order of ids
block      int           place in the shard
first      long          ids of the shard before this block
n_ids      int           ids in this block
bits       int           width of one id
doc_ids    array<long>   the documents of this block, whole and in order
doc_starts array<int>    where each document begins, in ids from the start of the block
payload    binary        id i is the ``bits`` bits from bit ``i * bits``, lowest bit first
========== ============= ==========================================================
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path, settle
from .common import id_order, portions, query, shipped, shuffle_width, starts_of, table
from .tokens import default_path, encoder

BLOCK_IDS = 1 << 16
# Bytes of text in one shard; the number of shards grows with the table.
SHARD_BYTES = 256 << 20
END = 1
BLOCKS = "shard int, block int, first long, n_ids int, bits int, doc_ids array<long>, doc_starts array<int>, payload binary"


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_bits(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low = start * bits
    raw = np.frombuffer(payload, np.uint8)[low // 8 : -(-(low + count * bits) // 8)]
    flat = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + count * bits].reshape(count, bits)
    out = np.zeros((count, 32), np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def write_store(docs: DataFrame, out: str, path: str | None = None, end: int = END, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole ``text``, append ``end`` and write the ids in ascending ``doc_id`` order.

    One range shuffle of the texts; each partition is a shard of about ``SHARD_BYTES`` of text at most (fewer where
    there are cores for more) and streams its blocks. A block holds whole documents, about ``block_ids`` ids or one
    longer document.

    A null or empty text is the end id alone. A null id comes last, in shards cut by a hash of the
    text, so that many of them are not one task; repeated ids stand side by side in no fixed order.
    An empty table makes an empty store; extra columns are not read.
    """
    path = path or default_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tool = encoder(path)
        bits = width_of(max(tool.vocabulary, end + 1))
        shard = TaskContext.get().partitionId()
        block = first = size = 0
        parts: list[np.ndarray] = []
        owners: list = []

        def flush():
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            payload = pack_bits(np.concatenate(parts), bits)
            values = (shard, block, first, size, bits, owners, starts_of(sizes).tolist(), payload)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            names = ["shard", "block", "first", "n_ids", "bits", "doc_ids", "doc_starts", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in itertools.chain.from_iterable(portions(whole, 1) for whole in batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tool.encode(text)
                parts.append(np.append(ids, ids.dtype.type(end)))
                owners.append(doc)
                size += len(parts[-1])
                if size >= block_ids:
                    yield flush()
                    block, first, size = block + 1, first + size, 0
                    parts, owners = [], []
        if parts:
            yield flush()
        tool.forget()

    texts = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    last = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ordered = texts.repartitionByRange(max(shuffle_width(docs), -(-size // SHARD_BYTES)), *id_order(), last).sortWithinPartitions(*id_order())
    ordered.mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "uncompressed").parquet(out)


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """One row per document of a store: (doc_id, start, n_tokens, ids_crc32[, ids]).

    ``start`` counts the ids of all documents before it, over all shards: shards carry their own
    running counts, so only one row per shard meets in one place. ``ids_crc32`` is the checksum of the
    document's ids as little-endian unsigned 32-bit values, and ``ids`` those bytes.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    shards = settle(blocks.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("n")))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("shift"))

    def run(batches):
        import pyarrow as pa

        names = ["shard", "doc_id", "local", "n_tokens", "ids_crc32"] + ["ids"] * ids
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
        for batch in batches:
            for row in batch.to_pylist():
                owners, starts = row["doc_ids"], row["doc_starts"]
                flat = memoryview(unpack_bits(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4").tobytes())
                stops = [*starts[1:], row["n_ids"]]
                data = [flat[4 * a : 4 * b] for a, b in zip(starts, stops)]
                columns = [[row["shard"]] * len(owners), owners, [row["first"] + a for a in starts]]
                columns += [[b - a for a, b in zip(starts, stops)], [zlib.crc32(d) for d in data]]
                columns += [[bytes(d) for d in data]] * ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    found = blocks.mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    more = ["ids"] * ids
    # one row per writing partition, so its size is bounded by their number
    return found.join(F.broadcast(shards), "shard").select("doc_id", (F.col("local") + F.col("shift")).alias("start"), "n_tokens", "ids_crc32", *more)


def read_range(spark: SparkSession, path: str, shard: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a shard: random access by the block offsets.

    Only the blocks that hold them are read, by a filter on their offsets; ``count`` is the caller's.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    hit = blocks.where((F.col("shard") == shard) & (F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start))
    parts = []
    for row in hit.orderBy("block").select("first", "n_ids", "bits", "payload").collect():
        low, high = max(start, row["first"]), min(start + count, row["first"] + row["n_ids"])
        parts.append(unpack_bits(row["payload"], row["bits"], low - row["first"], high - low))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@query("op4_bit_packed_tokens")
def op4(spark, sf_dir):
    out = scratch_path(spark, "token_store")
    write_store(table(spark, sf_dir, "documents"), out)
    return read_documents(spark, out)
