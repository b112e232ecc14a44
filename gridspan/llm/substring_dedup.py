"""Substring deduplication: passages of words that an earlier document already has.

Windows of 13 words are grouped by their hashes: two suffixes share their first 13 words exactly if both
would hang below one node of depth 13 or more in the corpus's suffix tree. That tree is not built, and
suffixes are not sorted by their words or compared past the 13th.

1. Documents are dealt into chunks of bounded size, once; every later step reads that shuffle.
2. A window that holds a rarest 5-word run seen in one document only is alone in its group and is left
   out. The rarest run of a window is the one with the smallest hash among its nine.
3. The windows left are dealt out by ranges of their hashes. The smallest document of a group keeps the
   passage. A chunk sends each passage once, with its smallest document, so a passage in a third of all
   documents is one row per chunk.
4. Groups answer the chunks whose documents come later, and windows that are removed merge into the
   maximal repeated spans.

Words are compared by 64-bit hashes; a window by 32 bits of its first word and 64 bits of all 13.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, query, row_type, shipped, shuffle_width, table, texts_of

WINDOW = 13
ANCHOR = 5
CHUNK_BYTES = 4 << 20
NO_ID = (1 << 63) - 1  # stands for a null id: later than every document


class _Chunk:
    """Windows of the documents of one chunk: place of the first word, document, key and anchor."""

    def __init__(self, docs, window: int):
        ids = docs.column("id")
        self.ids = ids.fill_null(NO_ID).to_numpy().astype(np.int64)
        text = docs.column("row").combine_chunks().field("text")
        self.null = text.is_null().to_pylist()
        self.texts = texts_of(text.cast("string"))
        words = self.words = Words(self.texts)
        self.at, self.whole = words.runs(window)
        code = words.code
        self.lead = (code[self.at] >> np.uint64(32)).astype(np.uint32)
        self.owner = self.ids[words.doc[self.at]]
        reach = window - ANCHOR + 1
        grams = np.full(len(code) + reach, ~np.uint64(0), np.uint64)
        where, value = words.runs(ANCHOR)
        grams[where] = value
        # minimum over `reach` places from doubled steps
        width, low = 1, grams
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
        # 48 bits travel smaller; windows whose anchors are only equal in these are compared once more, no less
        self.anchor = low[self.at] >> np.uint64(16)

    def least(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows sorted by key, the first of each run of equal keys, and the smallest id in each run."""
        order = np.argsort(self.whole, kind="stable")
        whole, lead = self.whole[order], self.lead[order]
        same = whole[1:] == whole[:-1]
        if (same & (lead[1:] != lead[:-1])).any():
            order = np.lexsort((self.lead, self.whole))
            whole, lead = self.whole[order], self.lead[order]
        new = np.ones(len(order), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (lead[1:] != lead[:-1])
        starts = np.flatnonzero(new)
        smallest = np.minimum.reduceat(self.owner[order], starts) if len(starts) else np.zeros(0, np.int64)
        return order, starts, smallest


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64 if values.itemsize == 8 else np.int32)


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``docs`` as (row, n_words, n_removed, kept_text, span_starts, span_words).

    ``row`` is a struct of all columns. A word goes if a window of ``window`` words over it also starts in
    a document with a smaller ``doc_id``; windows are judged on the input. ``span_starts`` and
    ``span_words`` are the maximal runs of removed words, in words. ``kept_text`` is the text without
    them; each span takes the white space after it along, and a text that loses nothing stays as it is.

    A null text counts as empty and stays null; a null id is later than every other; rows with one id
    (repeated rows) do not remove each other's words; texts of under ``window`` words lose nothing; a very
    long text is a chunk alone; an empty table gives no rows; extra columns travel in ``row``.
    """
    fields = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id")]
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    chunks = max(4 * shuffle_width(docs), -(-int(total) // chunk_bytes))
    dealt = shipped(docs).select(*fields).withColumn("chunk", F.pmod(F.xxhash64("id", "row.text"), F.lit(chunks)).cast("int"))
    by_chunk = dealt.groupBy("chunk")

    def anchors(docs):
        import pyarrow as pa

        part = _Chunk(docs, window)
        new = np.ones(len(part.at), bool)
        new[1:] = (part.anchor[1:] != part.anchor[:-1]) | (part.owner[1:] != part.owner[:-1])
        where = np.flatnonzero(new)
        anchor, owner = part.anchor[where], part.owner[where]
        order = np.argsort(anchor, kind="stable")
        sorted_ = anchor[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(owner[order], starts) if len(starts) else owner
        high = np.maximum.reduceat(owner[order], starts) if len(starts) else owner
        # rows leave in the order of the text, where neighbours differ in little but the hash
        text_order = np.argsort(order[starts])
        chunk = np.full(len(starts), docs.column("chunk")[0].as_py(), np.int32)
        columns = {"anchor": _signed(sorted_[starts]), "chunk": chunk, "low": low, "spread": high - low}
        return pa.table({k: v[text_order] for k, v in columns.items()})

    def suffixes(docs, shared):
        import pyarrow as pa

        kinds = {"lead": pa.int32(), "whole": pa.int64(), "chunk": pa.int32(), "first": pa.int64()}
        if not docs.num_rows or not shared.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        part = _Chunk(docs, window)
        kept = np.flatnonzero(np.isin(_signed(part.anchor), shared.column("anchor").to_numpy()))
        part.whole, part.lead, part.owner = part.whole[kept], part.lead[kept], part.owner[kept]
        order, starts, smallest = part.least()
        text_order = np.argsort(order[starts])
        place = order[starts][text_order]
        chunk = np.full(len(place), docs.column("chunk")[0].as_py(), np.int32)
        return pa.table({"lead": _signed(part.lead[place]), "whole": _signed(part.whole[place]), "chunk": chunk, "first": smallest[text_order]})

    def cut(docs, earlier):
        import pyarrow as pa

        part = _Chunk(docs, window)  # every answer is to a chunk that has documents
        words = part.words
        order, starts, smallest = part.least()
        # runs that an earlier document of another chunk has: answers found by key among the sorted runs
        known = np.zeros(len(starts), bool)
        run_whole, run_lead = part.whole[order[starts]], part.lead[order[starts]]
        whole = earlier.column("whole").to_numpy().view(np.uint64)
        lead = earlier.column("lead").to_numpy().view(np.uint32)
        at = np.searchsorted(run_whole, whole)
        while len(at):
            hit = run_lead[at] == lead
            known[at[hit]] = True
            at, lead = at[~hit] + 1, lead[~hit]  # another window with this hash
        size = np.diff(np.append(starts, len(order)))
        gone = np.zeros(len(order), bool)
        gone[order] = np.repeat(known, size) | (part.owner[order] > np.repeat(smallest, size))
        change = np.zeros(len(words.start) + window + 1, np.int32)
        np.add.at(change, part.at[gone], 1)
        np.add.at(change, part.at[gone] + window, -1)
        covered = np.cumsum(change)[: len(words.start)] > 0
        n_removed = np.bincount(words.doc, covered, len(part.texts)).astype(np.int64)
        flip = np.ones(len(covered), bool)
        flip[1:] = (covered[1:] != covered[:-1]) | (words.doc[1:] != words.doc[:-1])
        run_first = np.flatnonzero(flip)
        run_stop = np.append(run_first[1:], len(covered))
        spans = covered[run_first]
        run_first, run_stop = run_first[spans], run_stop[spans]
        run_doc = words.doc[run_first]
        bounds = np.searchsorted(run_doc, np.arange(len(part.texts) + 1))
        kept: list = [t.decode() if not null else None for t, null in zip(part.texts, part.null)]
        for doc in np.flatnonzero(n_removed).tolist():
            at, out = int(words.text_start[doc]), []
            stop = at + len(part.texts[doc])
            last = int(words.first[doc] + words.count[doc])
            for a, b in zip(run_first[bounds[doc] : bounds[doc + 1]].tolist(), run_stop[bounds[doc] : bounds[doc + 1]].tolist()):
                out.append(words.data[at : int(words.start[a])])
                at = int(words.start[b]) if b < last else int(words.end[b - 1])
            kept[doc] = b"".join([*out, words.data[at:stop]]).decode()
        each = pa.array(bounds.astype(np.int32))
        columns = {
            "row": docs.column("row").combine_chunks(),
            "n_words": pa.array(words.count),
            "n_removed": pa.array(n_removed),
            "kept_text": pa.array(kept, pa.string()),
            "span_starts": pa.ListArray.from_arrays(each, pa.array((run_first - words.first[run_doc]).astype(np.int32))),
            "span_words": pa.ListArray.from_arrays(each, pa.array((run_stop - run_first).astype(np.int32))),
        }
        return pa.table(columns)

    same = Window.partitionBy("anchor")
    seen = by_chunk.applyInArrow(anchors, "anchor long, chunk int, low long, spread long")
    shared = seen.select("anchor", "chunk", F.min("low").over(same).alias("least"), F.max(F.col("low") + F.col("spread")).over(same).alias("most"))
    shared = shared.where("least < most").select("chunk", "anchor")
    leaves = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(suffixes, "lead int, whole long, chunk int, first long")
    node = Window.partitionBy("lead", "whole")
    tree = leaves.repartitionByRange("lead", "whole").withColumn("least", F.min("first").over(node))
    earlier = tree.where("least < first").select("chunk", "lead", "whole")
    out = T.StructType(
        [
            T.StructField("row", row_type(docs)),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
            T.StructField("span_starts", T.ArrayType(T.IntegerType())),
            T.StructField("span_words", T.ArrayType(T.IntegerType())),
        ]
    )
    return by_chunk.cogroup(earlier.groupBy("chunk")).applyInArrow(cut, out)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the kept text in ``text`` and its length in ``n_chars``, where there is such a column.

    Documents that had words and lose all of them go.
    """
    found = remove_repeats(docs, window).where("n_words = 0 OR n_removed < n_words")
    columns = []
    for name in docs.columns:
        value = F.col("row").getField(name)
        if name == "text":
            value = F.col("kept_text")
        elif name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return found.select(*columns)


_SPACES = "[\\x20\\x09-\\x0D]+"


_SQL = (
    "WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), "
    "windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t) u), "
    "firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS f FROM windows), "
    "gone AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT doc_id, i, unnest(range(13)) AS j FROM firsts WHERE f < doc_id) v), "
    "words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM t), "
    "kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS k, count(gone.pos) AS n "
    "FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY 1) "
    "SELECT t.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"
)


@query("op1_substring_dedup", _SQL)
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = remove_repeats(docs)
    words = F.trim(F.regexp_replace(F.coalesce("kept_text", F.lit("")), _SPACES, " "))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
