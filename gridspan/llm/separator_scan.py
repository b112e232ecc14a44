"""Token counts of flat token files that have no index.

A flat file is only ids, one document after another, each closed by an end-of-document id. Blocks of
a file are scanned for that id by themselves; documents that straddle blocks are put together by a
prefix scan over one summary row per block.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import prefix_scan
from ..session import scratch_path
from .common import portions, query, shipped, table
from .tokens import default_path, encoder

BLOCK_BYTES = 1 << 18
END = 0xFFFF


def write_flat(docs: DataFrame, out: str, order_out: str, path: str | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of every whole ``text`` as flat streams of unsigned 16-bit values, cut into blocks.

    ``out`` gets rows (file, block, payload): the blocks of each stream, of ``block_bytes`` bytes but for
    the last, cut without regard to documents and without an index. ``order_out`` gets (file, doc_no,
    doc_id), so that what is counted can be told by document. A stream is one input split; nothing is
    shuffled. The separator is 0xFFFF, which the vocabulary doesn't reach.

    A null or empty text is the separator alone; null ids and repeated rows are written like others; a very long
    text is many blocks; an empty table makes streams without blocks; extra columns are not read.
    """
    path = path or default_path()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        tool = encoder(path)
        if tool.dtype.itemsize != 2 or tool.vocabulary > END:
            raise ValueError("the vocabulary reaches the separator")
        stop = END.to_bytes(2, "little")
        file = TaskContext.get().partitionId()
        parts, size, block, doc_no = [], 0, 0, 0
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        names = ["file", "block", "payload", "doc_no", "doc_ids"]

        def row(payload, n, first, owners):
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((file, n, payload, first, owners), kinds)], names)

        for batch in itertools.chain.from_iterable(portions(whole, 1) for whole in batches):
            owners = batch.column(0).to_pylist()
            yield row(None, None, doc_no, owners)
            doc_no += len(owners)
            for text in batch.column(1).to_pylist():
                data = tool.encode(text).tobytes() + stop
                parts.append(data)
                size += len(data)
                if size >= block_bytes:
                    flat = b"".join(parts)
                    whole = size - size % block_bytes
                    for a in range(0, whole, block_bytes):
                        yield row(flat[a : a + block_bytes], block, None, None)
                        block += 1
                    parts, size = [flat[whole:]], size - whole
        if size:
            yield row(b"".join(parts), block, None, None)
        tool.forget()

    texts = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "file long, block long, payload binary, doc_no long, doc_ids array<long>"
    both = texts.mapInArrow(run, schema).withColumn("part", F.when(F.col("block").isNull(), "order").otherwise("blocks"))
    both.write.mode("overwrite").option("compression", "uncompressed").partitionBy("part").parquet(out)
    spark = docs.sparkSession
    listed = spark.read.schema(f"{schema}, part string").parquet(out).where("part = 'order'")
    ranked = listed.select("file", "doc_no", F.posexplode("doc_ids").alias("i", "doc_id"))
    ranked.select("file", (F.col("doc_no") + F.col("i")).alias("doc_no"), "doc_id").write.mode("overwrite").parquet(order_out)


def flat_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks (file, block, payload) that :func:`write_flat` wrote."""
    schema = "file long, block long, payload binary, doc_no long, doc_ids array<long>, part string"
    return spark.read.schema(schema).parquet(path).where("part = 'blocks'").select("file", "block", "payload")


def raw_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks of plain ``.bin`` files of under 2 GB each, cut by binary slices; ``file`` is a hash of the path."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "content", "length")
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0))
    cut = files.select("file", "content", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    at = (F.col("block") * block_bytes + 1).cast("int")
    return cut.select("file", "block", F.substring("content", at, F.lit(block_bytes)).alias("payload"))


def count_tokens(blocks: DataFrame, end: int = END, id_bytes: int = 2) -> DataFrame:
    """(file, doc_no, start, n_tokens) of every document of flat token files, the end id not counted.

    ``blocks`` has rows (file, block, payload) with blocks numbered from 0, all of one size within a file
    but the last. Ids after the last end id of a file are a last document without one. Blocks without an
    end id, documents over many blocks, and empty documents (two end ids in a row) are counted right;
    an empty or null payload has no ids; an empty table gives no rows; extra columns are not read.
    ``start`` is the place of the document's first id in its file.
    """
    kind = f"<u{id_bytes}"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [np.frombuffer(p or b"", kind) for p in batch.column(2).to_pylist()]
            ends = [np.flatnonzero(x == end) for x in ids]
            bounds = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)]).astype(np.int32)))
            sizes = pa.array([len(x) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, places], ["file", "block", "n_ids", "ends"])

    seen = shipped(blocks).select("file", F.col("block").cast("long").alias("block"), "payload").mapInArrow(run, "file long, block long, n_ids long, ends array<int>")
    # ids and documents before the block, and the first id after the last end before it
    seen = prefix_scan(seen, ["file"], "block", {"_ids": ("sum_before", F.col("n_ids"))})
    last = F.when(F.size("ends") > 0, F.col("_ids") + F.element_at("ends", -1) + 1)
    wanted = {
        "_docs": ("sum_before", F.size("ends").cast("long")),
        "_open": ("max_before", last),
    }
    seen = prefix_scan(seen, ["file"], "block", wanted)
    stops = F.transform("ends", lambda e: F.col("_ids") + e)
    begins = F.concat(F.array(F.coalesce("_open", F.lit(0).cast("long"))), F.transform("ends", lambda e: F.col("_ids") + e + 1))
    closed = seen.select("file", "_docs", F.posexplode(F.arrays_zip(stops.alias("stop"), F.slice(begins, 1, F.size("ends")).alias("begin"))).alias("i", "d"))
    closed = closed.select("file", (F.col("_docs") + F.col("i")).alias("doc_no"), F.col("d.begin").alias("start"), (F.col("d.stop") - F.col("d.begin")).alias("n_tokens"))
    tail = seen.groupBy("file").agg(
        F.sum(F.size("ends")).cast("long").alias("doc_no"), F.coalesce(F.max(last), F.lit(0).cast("long")).alias("start"), F.max(F.col("_ids") + F.col("n_ids")).alias("stop")
    )
    tail = tail.where("stop > start").select("file", "doc_no", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
    return closed.unionByName(tail)


@query("op5_separator_token_counts")
def op5(spark, sf_dir):
    out, order = scratch_path(spark, "flat"), scratch_path(spark, "flat_order")
    write_flat(table(spark, sf_dir, "documents"), out, order)
    counted = count_tokens(flat_blocks(spark, out))
    return counted.join(spark.read.parquet(order), ["file", "doc_no"]).select("doc_id", "file", "doc_no", "start", "n_tokens")
