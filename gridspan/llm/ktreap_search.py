"""Ranked lexical search in K2-treaps over the term-document grid.

A block of documents is a grid with a row per term and a column per document; a cell holds the term's impact
in the document. The grid is cut into quadrants again and again. Only quadrants with cells are nodes: four bits
tell which children a node has, and each node keeps the greatest impact below it, as the difference to its
parent's. A search descends the row paths of all its terms together, best first: a range of documents is
bounded by the sum of its terms' weighted maxima, halved, and left when it cannot reach the best found.
"""

from __future__ import annotations

import itertools
from array import array
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..session import settle
from .common import query, shipped, starts_of, table

MOST = 10
# Cells of one block, and distinct terms that a task counts together.
CELLS, TERMS = 1 << 19, 1 << 18
# Bytes of searches that go to the tasks at once; more take more passes over the index.
CHUNK = 8 << 20
# Document ranges that one step of a search halves.
BEAM = 256

# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] are letters of terms, A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_INDEX = "docs array<long>, terms binary, depth int, top long, children binary, drops binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _texts(batch, i):
    import pyarrow as pa

    return (t or b"" for t in batch.column(i).cast(pa.binary()).to_pylist())


def statistics(docs: DataFrame) -> DataFrame:
    """(term, df, terms): documents that hold a term; the row of the null term has documents with terms, and all terms."""

    def run(batches):
        import pyarrow as pa

        def flush(held, n_docs, n_terms):
            columns = [pa.array([None, *held], pa.binary()), pa.array([n_docs, *held.values()], pa.int64()), pa.array([n_terms] + [0] * len(held), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["term", "df", "terms"])

        held, n_docs, n_terms = Counter(), 0, 0
        for batch in batches:
            for text in _texts(batch, 0):
                terms = terms_of(text)
                if terms:
                    held.update(set(terms))
                    n_docs, n_terms = n_docs + 1, n_terms + len(terms)
                if len(held) > TERMS:
                    yield flush(held, n_docs, n_terms)
                    held, n_docs, n_terms = Counter(), 0, 0
        if held:
            yield flush(held, n_docs, n_terms)

    counted = shipped(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term binary, df long, terms long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("terms").alias("terms"))


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers under 2**32 at every other place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def planted(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray, depth: int) -> tuple[int, bytes, bytes]:
    """The treap of cells (row, column, impact) of a grid of side 2**depth: greatest impact, child bits, differences.

    Nodes stand level by level from the root, in the order of their quadrants, so a node's number is the
    number of child bits set before its own.
    """
    codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(codes)
    codes, high = codes[order], impacts[order]
    children, drops = [], []
    for _ in range(depth):
        above = codes >> np.uint64(2)
        new = np.concatenate([[True], above[1:] != above[:-1]])
        first = np.flatnonzero(new)
        parent = np.cumsum(new) - 1
        bits = np.zeros(4 * len(first), bool)
        bits[4 * parent + (codes & np.uint64(3)).astype(np.int64)] = True
        top = np.maximum.reduceat(high, first)
        children.append(bits)
        drops.append((top[parent] - high).astype(np.uint32))
        codes, high = above[first], top
    return int(high[0]), np.packbits(np.concatenate(children[::-1])).tobytes(), np.concatenate(drops[::-1]).tobytes()


class Treap:
    """A treap to search in. Node 0 is none, with impact 0 and no children; node 1 is the root."""

    def __init__(self, depth: int, top: int, children: bytes, drops: bytes):
        self.depth = depth
        down = np.frombuffer(drops, np.uint32)
        bits = np.unpackbits(np.frombuffer(children, np.uint8))
        at = np.flatnonzero(bits)
        self.child = np.zeros(4 + len(bits), np.int32)
        self.child[4 + at] = np.arange(2, len(at) + 2, dtype=np.int32)
        parent = at // 4 + 1
        self.high = np.zeros(len(at) + 2, np.int32)
        self.high[1] = top
        first, last = 1, 2
        for _ in range(depth):
            # the children of the nodes [first, last) are the next ones
            low, up = np.searchsorted(parent, first), np.searchsorted(parent, last)
            self.high[low + 2 : up + 2] = self.high[parent[low:up]] - down[low:up]
            first, last = last, up + 2

    def search(self, rows: np.ndarray, weights: np.ndarray, docs: list, most: int, best: list) -> list:
        """``best`` with this block's documents: at most ``most`` of (-score, id is null, id), in order."""
        bound, level, column = np.array([int(self.high[1]) * int(weights.sum())]), np.zeros(1, np.int64), np.zeros(1, np.int64)
        paths = np.ones((1, len(rows)), np.int64)
        floor = -best[-1][0] if len(best) == most else 1
        while True:
            alive = bound >= floor
            if not alive.all():
                bound, level, column, paths = bound[alive], level[alive], column[alive], paths[alive]
            if not len(bound):
                return best
            rest = np.zeros(len(bound), bool)
            if len(bound) > BEAM:
                rest[np.argpartition(-bound, BEAM)[BEAM:]] = True
            go = ~rest
            at = level[go]
            turn = 4 * paths[go] + 2 * ((rows[None, :] >> (self.depth - 1 - at)[:, None]) & 1)
            down = np.concatenate([self.child[turn], self.child[turn + 1]])
            score = (self.high[down] * weights).sum(axis=1)
            at = np.concatenate([at, at]) + 1
            place = np.concatenate([2 * column[go], 2 * column[go] + 1])
            good = score >= floor
            leaf = good & (at == self.depth)
            if leaf.any():
                found = [(-s, docs[c] is None, docs[c] or 0) for s, c in zip(score[leaf].tolist(), place[leaf].tolist())]
                best = sorted(best + found)[:most]
                floor = -best[-1][0] if len(best) == most else 1
            good &= at < self.depth
            bound, level, column = (np.concatenate([a[rest], b[good]]) for a, b in ((bound, score), (level, at), (column, place)))
            paths = np.concatenate([paths[rest], down[good]])


def index(docs: DataFrame, n_docs: int, n_terms: int, cells: int = CELLS) -> DataFrame:
    """A row per block of documents: its ids, its terms and its treap. Every document with a term is in one block.

    Impacts need the number of documents with terms and of all terms. A block takes documents until it has
    ``cells`` cells. Rows are ordered by frequency and columns by the document's most frequent term, so that
    like stands beside like and many quadrants are empty.
    """

    def run(batches):
        import pyarrow as pa

        def flush(ids, sizes, rows, counts, numbers):
            rows, counts, sizes = np.frombuffer(rows, np.int64), np.frombuffer(counts, np.int64), np.array(sizes)
            columns = np.repeat(np.arange(len(sizes)), sizes)
            terms = list(numbers)
            order = np.argsort(-np.bincount(rows, minlength=len(terms)), kind="stable")
            place = np.empty(len(terms), np.int64)
            place[order] = np.arange(len(terms))
            rows = place[rows]
            first = starts_of(sizes)
            length = np.add.reduceat(counts, first)
            leading = np.minimum.reduceat(np.where(counts == np.maximum.reduceat(counts, first)[columns], rows, len(terms)), first)
            sorted_docs = np.argsort(leading, kind="stable")
            moved = np.empty(len(sizes), np.int64)
            moved[sorted_docs] = np.arange(len(sizes))
            spread = np.array([10 + 90 * n * n_docs // n_terms for n in length.tolist()], np.int64)
            impacts = 1_000_000_000 * counts // (1000 * counts + 8 * spread[columns])
            depth = max(1, (max(len(terms), len(sizes)) - 1).bit_length())
            top, children, drops = planted(rows, moved[columns], impacts, depth)
            kinds = [pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            row = [[ids[i] for i in sorted_docs], b" ".join([terms[i] for i in order]), depth, top, children, drops]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["docs", "terms", "depth", "top", "children", "drops"])

        def empty():
            numbers = defaultdict()
            numbers.default_factory = numbers.__len__
            return [], [], array("q"), array("q"), numbers

        held = empty()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                counted = Counter(terms_of(text))
                if not counted:
                    continue
                ids, sizes, rows, counts, numbers = held
                ids.append(doc_id)
                sizes.append(len(counted))
                rows.extend(map(numbers.__getitem__, counted))
                counts.extend(counted.values())
                if len(rows) >= cells:
                    yield flush(*held)
                    held = empty()
        if held[0]:
            yield flush(*held)

    texts = shipped(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, _INDEX)


def _found(searches: list[tuple[int, list[bytes], np.ndarray]], most: int):
    """(search, doc_id, score): the best documents of a task's blocks for every search.

    What earlier blocks of the task have found bounds the descent in later ones.
    """
    wanted = set(itertools.chain.from_iterable(terms for _, terms, _ in searches))

    def run(batches):
        import pyarrow as pa

        best: list[list] = [[] for _ in searches]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                here = {t: n for n, t in enumerate(row["terms"].split(b" ")) if t in wanted}
                treap = Treap(row["depth"], row["top"], row["children"], row["drops"]) if here else None
                for j, (_, terms, weights) in enumerate(searches):
                    at = [k for k, t in enumerate(terms) if t in here]
                    if at:
                        rows = np.array([here[terms[k]] for k in at], np.int64)
                        best[j] = treap.search(rows, weights[at], row["docs"], most, best[j])
        out = [(number, None if none else doc, -score) for (number, _, _), found in zip(searches, best) for score, none, doc in found]
        columns = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["search", "doc_id", "score"])

    return run


def _chunks(weighted: DataFrame, size: int):
    """The searches in lists of about ``size`` bytes each; one list at a time is on the driver."""
    held, used = [], 0
    for row in weighted.toLocalIterator():
        terms = [bytes(x["term"]) for x in row["terms"]]
        held.append((row["search"], terms, np.array([x["weight"] for x in row["terms"]], np.int64)))
        used += sum(map(len, terms)) + 80 * len(terms) + 100
        if used >= size:
            yield held
            held, used = [], 0
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, most: int = MOST, cells: int = CELLS, chunk: int = CHUNK) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents for each row of ``items`` (item_id, text).

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. A term's
    weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact in a document (1000000000 tf) div (1000 tf + 8 m)
    with m = 10 + (90 n N) div L, and a document's score the sum of both multiplied over the item's terms, once each.
    Scores are exact and all documents with a score above 0 compete; equal scores are in order of the id.

    1. One pass counts documents by term, with partial sums per task.
    2. One pass builds the blocks and searches them where they are built; each task returns at most ``most`` rows
       per item, which are merged in two steps. Searches are shipped in chunks; if there is more than one, the
       index is settled and read once per chunk.

    Null texts have no terms: such documents are in no result and such items have none. Null document ids come
    last among equal scores. Rows that repeat are documents, and items, of their own. Very long texts are whole
    columns of one block, whose size they exceed alone. Empty tables give no rows; extra columns are not read.
    """
    counted = settle(statistics(docs))
    total = counted.where("term IS NULL").first()
    if total is None:
        kinds = {"rank": "int", "doc_id": "long", "score": "long"}
        return items.select("item_id", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items())).where(F.lit(False))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            terms = [sorted(set(terms_of(t))) for t in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["search", "terms"])

    asked = settle(shipped(items).select("item_id", F.col("text").cast("string").alias("text")).withColumn("search", F.monotonically_increasing_id()))
    pairs = asked.select("search", "text").mapInArrow(split, "search long, terms array<binary>").select("search", F.explode("terms").alias("term"))
    ratio = F.lit(2.0 * total["df"] + 2) / (2.0 * F.col("df") + 1)
    weights = counted.join(pairs.select("term").distinct(), "term").select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("weight")).where("weight > 0")
    weighted = lookup_join(pairs, settle(weights), ["term"], "inner")
    weighted = settle(weighted.groupBy("search").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("terms")))

    blocks, found = index(docs, total["df"], total["terms"], cells), None
    chunks = _chunks(weighted, chunk)
    first, second = next(chunks, []), next(chunks, None)
    if second is not None:
        blocks = settle(blocks)
    for searches in itertools.chain([first], [] if second is None else [second], chunks):
        part = blocks.mapInArrow(_found(searches, most), "search long, doc_id long, score long")
        found = part if found is None else found.unionAll(part)
    order = [F.desc("score"), F.col("doc_id").isNull(), F.col("doc_id")]
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("search", "salt").orderBy(*order))).where(F.col("rank") <= most)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(*order))).where(F.col("rank") <= most)
    return lookup_join(found, asked.select("search", "item_id"), ["search"], "inner").select("item_id", "rank", "doc_id", "score")


_TERM_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)


@query(
    "op11_k2_treap_search",
    f"WITH d AS MATERIALIZED (SELECT doc_id, {_TERM_SQL} AS t FROM documents), "
    "s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d), "
    "tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL), "
    "w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term), "
    "m AS (SELECT doc_id, 100 - 90 + ((90 * len(t) * n_docs) // n_terms) AS m FROM d, s), "
    f"i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERM_SQL}) AS term FROM benchmark)), "
    "scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score "
    "FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id HAVING score > 0), "
    "ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored) "
    "SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10",
)
def op11(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
