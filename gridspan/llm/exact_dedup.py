"""Exact deduplication by Grace hashing: spill by digest bits until a bucket fits one table."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join, small_side
from ..session import settle
from .common import SPACES, portions, query, shipped, shuffle_width, table, texts_of

BUCKET_BYTES = 32 << 20
TABLE_BYTES = 32 << 20
_PORTION = 4 << 20
PARTS = "digest binary, content binary, n long, length long, best_id long"
_STEP_BITS = 4
_MOST_BITS = 56


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


class ContentTable:
    """Open addressing over whole contents: equal digests are only a hint, bytes decide.

    A content has the number of its rows, and the length and id of the best one: the longest, then the smallest
    id, null last.
    """

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.contents: list[tuple[bytes, bytes]] = []
        self.rows: list[int] = []
        self.best: list[tuple[int, bool, int]] = []
        self.size = 0

    def add(self, digest: bytes, content: bytes, rows: int, length: int, doc_id: int | None) -> None:
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        best = (-length, doc_id is None, doc_id or 0)
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (held := self.slots[at]) >= 0:
            if self.contents[held][1] == content:
                self.rows[held] += rows
                self.best[held] = min(self.best[held], best)
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.contents)
        self.contents.append((digest, content))
        self.rows.append(rows)
        self.best.append(best)
        self.size += len(content) + len(digest)

    def arrow(self, content=lambda i, c: c[1]):
        """The contents as a record batch of :data:`PARTS`; ``content`` tells what goes into that column."""
        import pyarrow as pa

        columns = [
            pa.array([c[0] for c in self.contents], pa.binary()),
            pa.array([content(i, c) for i, c in enumerate(self.contents)], pa.binary()),
            pa.array(self.rows, pa.int64()),
            pa.array([-b[0] for b in self.best], pa.int64()),
            pa.array([None if b[1] else b[2] for b in self.best], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["digest", "content", "n", "length", "best_id"])

    @classmethod
    def of(cls, parts) -> ContentTable:
        """One table of the contents of many."""
        held = cls()
        for row in zip(*(parts.column(c).to_pylist() for c in ("digest", "content", "n", "length", "best_id"))):
            held.add(*row)
        return held

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for i, (digest, _) in enumerate(self.contents):
            at = int.from_bytes(digest[-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _prefix(bits):
    """The leading ``bits`` bits of the digest as a number."""
    return F.expr(f"shiftrightunsigned(conv(hex(substring(digest, 1, 7)), 16, 10)::long, {_MOST_BITS} - {bits})")


def _buckets(sizes: DataFrame, first_bits: int, limit: int) -> list[int]:
    """The depths, in bits, at which some bucket still holds more bytes than fit.

    The recursion of Grace hashing, decided from one row per digest: a bucket over ``limit`` bytes is cut
    by the next bits until it fits or is one digest. Each round counts all digests; only its largest
    bucket comes back.
    """
    depths, bits = [first_bits], first_bits
    while bits < _MOST_BITS:
        counted = sizes.groupBy(_prefix(bits).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        if counted.where((F.col("bytes") > limit) & (F.col("n") > 1)).isEmpty():
            break
        bits = min(_MOST_BITS, bits + _STEP_BITS)
        depths.append(bits)
    return depths


def _bucketed(rows: DataFrame, sizes: DataFrame, depths: list[int], limit: int) -> DataFrame:
    """Add ``bucket``: the digest's prefix at the first depth where its bucket fits."""
    bucket = F.struct(F.lit(depths[-1]).alias("bits"), _prefix(depths[-1]).alias("prefix"))
    for bits in reversed(depths[:-1]):
        over = sizes.groupBy(_prefix(bits).alias(f"p{bits}")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        over = over.where((F.col("b") > limit) & (F.col("n") > 1)).select(f"p{bits}", F.lit(True).alias(f"over{bits}"))
        rows = rows.withColumn(f"p{bits}", _prefix(bits)).join(small_side(over), f"p{bits}", "left")
        bucket = F.when(F.col(f"over{bits}"), bucket).otherwise(F.struct(F.lit(bits).alias("bits"), _prefix(bits).alias("prefix")))
    return rows.select(bucket.alias("bucket"), "digest", "content", "n", "length", "best_id")


def _merge(parts):
    import pyarrow as pa

    return pa.Table.from_batches([ContentTable.of(parts).arrow()])


def _compare(bucket):
    """The groups of a bucket; the content only where one digest stands for several."""
    import pyarrow as pa

    held = ContentTable.of(bucket)
    several = {d for d, n in Counter(d for d, _ in held.contents).items() if n > 1}
    return pa.Table.from_batches([held.arrow(lambda i, c: c[1] if c[0] in several else None)])


def _merged_copies(parts: DataFrame, sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Contents that come from so many tasks that they would not fit a bucket, put together group by group.

    ``sizes`` has the bytes of a digest's content and how many tasks send it. Each round leaves one content of
    at least two, in as many groups as their bytes need, until one bucket takes the rest.
    """
    while True:
        over = sizes.where((F.col("n_bytes") * F.col("tasks") > limit) & (F.col("tasks") > 1))
        groups = F.least(F.ceil(F.col("tasks") / 2), F.ceil(F.col("n_bytes") * F.col("tasks") / limit)).cast("long")
        heavy = small_side(over.select("digest", groups.alias("groups")))
        if heavy.isEmpty():
            return parts, sizes
        dealt = parts.withColumn("part", F.spark_partition_id()).join(heavy, "digest", "left")
        many = dealt.where("groups IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("part"), F.col("groups")))
        fewer = many.groupBy("digest", "part").applyInArrow(_merge, PARTS)
        names = parts.columns
        parts = dealt.where("groups IS NULL").select(*names).unionByName(fewer.select(*names))
        sizes = sizes.join(heavy, "digest", "left").select("digest", "n_bytes", F.coalesce("groups", "tasks").alias("tasks"))


def copy_groups(
    docs: DataFrame,
    digest: Callable[[bytes], bytes] = sha256,
    bucket_bytes: int = BUCKET_BYTES,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, digest, keep_id, group_size, kept).

    Texts are equal when they are the same after every character of ``[\\x20\\x09-\\x0D]`` is deleted. Of
    equal texts the row with the most code points in the original text stays, then the smallest id.

    1. A survey gives (id, length, digest) per row; it is settled, being small.
    2. Contents are collapsed in tables of bounded size where they are read, with the number of their rows and
       the best of them, so a text with any number of copies leaves a task once per full table. Then they are
       dealt out by digest bits, more bits where a bucket would be too large for what arrives, and each
       bucket's table compares complete contents and adds up the groups.
    3. Rows take the group of their digest. Where one digest stands for more than one content, they take it by
       content instead.

    A null text counts as empty; a null id loses every tie; of rows equal in text and id the one read first
    stays; a very long text fills a table, or a bucket, alone; an empty table gives no rows; extra columns are
    not read.
    """
    texts = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def survey(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            for batch in portions(whole, 1, _PORTION):
                norm = [t.translate(None, SPACES) for t in texts_of(batch.column(1))]
                length = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
                columns = [batch.column(0), length, pa.array(list(map(digest, norm)), pa.binary()), pa.array(list(map(len, norm)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "digest", "n_bytes"])

    def collapse(batches):
        import pyarrow.compute as pc

        held = ContentTable()
        for whole in batches:
            for batch in portions(whole, 1, _PORTION):
                lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
                for doc_id, length, text in zip(batch.column(0).to_pylist(), lengths, texts_of(batch.column(1))):
                    content = text.translate(None, SPACES)
                    held.add(digest(content), content, 1, length, doc_id)
                    if held.size > table_bytes:
                        yield held.arrow()
                        held = ContentTable()
        if held.contents:
            yield held.arrow()

    rows = settle(texts.mapInArrow(survey, "doc_id long, n_chars long, digest binary, n_bytes long").withColumn("row", F.monotonically_increasing_id()))
    # a row's id begins with its partition
    sent = rows.groupBy("digest", F.shiftright("row", 33).alias("task")).agg(F.max("n_bytes").alias("n_bytes"))
    sizes = settle(sent.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("tasks")))
    parts, sizes = _merged_copies(texts.mapInArrow(collapse, PARTS), sizes, bucket_bytes)
    sizes = sizes.select("digest", (F.col("n_bytes") * F.col("tasks")).alias("n_bytes"))
    first_bits = max(6, (4 * shuffle_width(docs)).bit_length())
    depths = _buckets(sizes, first_bits, bucket_bytes)
    buckets = _bucketed(parts, sizes, depths, bucket_bytes)
    groups = settle(buckets.groupBy("bucket").applyInArrow(_compare, PARTS))

    clashes = groups.where("content IS NOT NULL").select("digest", "content")
    if not clashes.isEmpty():
        rows = _told_apart(texts, rows, clashes, digest)
    else:
        rows = rows.withColumn("variant", F.lit(0).cast("long"))
    key = ["digest", "variant"]
    variant = F.when(F.col("content").isNull(), F.lit(0)).otherwise(F.xxhash64("content"))
    groups = groups.select("digest", variant.alias("variant"), F.col("n").alias("group_size"), "length", F.col("best_id").alias("keep_id"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("length"))
    placed = settle(rows.join(groups, key).withColumn("kept", stays))
    # rows that repeat the best one's id and length: the first of them
    ties = placed.where("kept").groupBy(*key).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    ties = settle(ties.select(*key, "first"))
    if not ties.isEmpty():
        placed = lookup_join(placed, ties, key).withColumn("kept", F.col("kept") & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))
    return placed.select("doc_id", "n_chars", "digest", "keep_id", "group_size", "kept")


def _told_apart(texts: DataFrame, rows: DataFrame, clashes: DataFrame, digest) -> DataFrame:
    """Rows with ``variant``, found by content where one digest stands for several contents."""

    def keyed(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            content = [t.translate(None, SPACES) for t in texts_of(batch.column(1))]
            columns = [batch.column(0), pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())]
            columns += [pa.array(list(map(digest, content)), pa.binary()), pa.array(content, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "digest", "content"])

    numbered = clashes.withColumn("variant", F.xxhash64("content"))
    several = clashes.select("digest").distinct()
    again = texts.mapInArrow(keyed, "doc_id long, n_chars long, digest binary, content binary")
    again = again.join(numbered, ["digest", "content"]).withColumn("row", F.monotonically_increasing_id())
    plain = rows.join(several, "digest", "left_anti").withColumn("variant", F.lit(0).cast("long"))
    columns = ["doc_id", "n_chars", "digest", "row", "variant"]
    return plain.select(*columns).unionByName(settle(again.select(*columns)))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Kept rows are found by id, length and digest; of rows alike in all three (copies of one row) any one
    stays. One shuffle of the texts by these, beside those of :func:`copy_groups`.
    """
    kept = copy_groups(docs).where("kept").select("doc_id", "n_chars", "digest")
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
        F.unhex(F.sha2(norm, 256)).alias("hash"),
    )
    same = rows["id"].eqNullSafe(kept["doc_id"]) & (rows["size"] == kept["n_chars"]) & (rows["hash"] == kept["digest"])
    once = rows.join(kept, same, "left_semi").dropDuplicates(["id", "size", "hash"])
    return once.select("row.*")


@query(
    "op9_grace_exact_dedup",
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS original, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents), "
    "g AS (SELECT doc_id, sha256(norm) AS text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t "
    "WINDOW w AS (PARTITION BY norm ORDER BY length(original) DESC, doc_id)) "
    "SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g",
)
def op9(spark, sf_dir):
    groups = copy_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
