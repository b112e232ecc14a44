"""Embedding near-duplicates by a pivot-permutation index.

Reference points are drawn from the vectors and thinned until no two are close. A vector is described by its
nearest reference points in order; near vectors have nearly the same ones. Inverted lists per label and
reference point bring vectors with common ones together, pairs with too few common ones are left out, and
the rest is verified by cosine in double precision.

A pair with ``SHARED`` common points among ``PREFIX`` has one of them among the first
``PREFIX - SHARED + 1`` of both in any fixed order of the points, so a vector is listed under those only,
rarest first, and a pair is compared in the list of its first common point alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..session import settle
from .common import query, shipped, shuffle_width, table
from .components import components

THRESHOLD = 0.98
# Reference points drawn: this many times the square root of the number of vectors, within bounds.
DRAWN, FEWEST, MOST = 4, 64, 16_384
APART = 0.8
PREFIX, SHARED = 6, 2
# Vectors of one side of a comparison, and list entries of one group.
BLOCK, BUCKET = 2048, 8192


def references(vectors: DataFrame, drawn: int, apart: float = APART) -> dict[int, np.ndarray]:
    """Unit reference points by dimension: the ``drawn`` vectors of smallest hash, thinned.

    Of two drawn vectors with a cosine of ``apart`` or more only the first stays. A dense group would
    otherwise fill its members' descriptions with points that are all equally near, in random order.
    """
    rows = vectors.orderBy(F.xxhash64("rep", F.lit(12)), "rep").limit(drawn).select("embedding").collect()
    by_size: dict[int, list] = {}
    for row in rows:
        by_size.setdefault(len(row[0]), []).append(row[0])
    out = {}
    for size, points in by_size.items():
        units = _units(np.array(points, np.float64))
        kept: list[int] = []
        for i, point in enumerate(units):
            if not kept or (units[kept] @ point).max() < apart:
                kept.append(i)
        out[size] = units[kept]
    return out


def _units(points: np.ndarray) -> np.ndarray:
    # scaled first, so that no square overflows or vanishes
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1))[:, None]


def _rows_of(column) -> np.ndarray:
    """The equally long lists of an Arrow column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _describe(points: dict[int, np.ndarray], prefix: int):
    """Adds ``near``: the nearest reference points of the vector's own dimension, nearest first."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index("embedding"))
            sizes = pc.list_value_length(column).to_numpy()
            near: list = [[]] * len(sizes)
            for size in np.unique(sizes):
                held = points.get(int(size))
                if held is None:
                    continue
                at = np.flatnonzero(sizes == size)
                score = _units(_rows_of(column.take(pa.array(at)))) @ held.T
                first = np.argsort(-score, axis=1, kind="stable")[:, :prefix]
                for i, row in zip(at, first.tolist()):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "near"])

    return run


def _listed(place: dict[int, np.ndarray], shared: int):
    """A row per list of a vector: ``near`` in the fixed order of the points, and ``list``.

    A vector of a dimension that no reference point has is in the one list -1 of its dimension.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            near = batch.column(names.index("near")).to_pylist()
            sizes = batch.column(names.index("size")).to_pylist()
            rows, lists, ordered = [], [], []
            for i, (row, size) in enumerate(zip(near, sizes)):
                order = sorted(int(place[size][p]) for p in row) if row else [-1]
                for p in order[: len(order) - min(shared, len(order)) + 1]:
                    rows.append(i)
                    lists.append(p)
                    ordered.append(order)
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [c for n, c in zip(names, taken.columns) if n != "near"]
            columns += [pa.array(ordered, pa.list_(pa.int32())), pa.array(lists, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*[n for n in names if n != "near"], "near", "list"])

    return run


def linked(near_a: np.ndarray, near_b: np.ndarray, a: np.ndarray, b: np.ndarray, here: int, shared: int, threshold: float):
    """Pairs (row of a, row of b) that share ``shared`` points, the first of which is ``here``, and whose cosine reaches ``threshold``."""
    points, flat = np.unique(np.concatenate([near_a, near_b]), return_inverse=True)
    flat = flat.reshape(-1, near_a.shape[1])
    has = np.zeros((len(flat), len(points)), np.float32)
    has[np.arange(len(flat))[:, None], flat] = 1
    one, two = has[: len(near_a)], has[len(near_a) :]
    before = int(np.searchsorted(points, here))
    candidates = one @ two.T >= min(shared, near_a.shape[1])
    if before:
        candidates &= one[:, :before] @ two[:, :before].T == 0
    return np.nonzero(candidates & (a @ b.T >= threshold))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row each row is connected with."""
    root = np.arange(n)
    while True:
        low, now = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _verify(shared: int, threshold: float):
    """Per list of a group: each vector's number of links (weighted by copies), and links that connect as all found do."""

    def run(group):
        import pyarrow as pa

        names = ["label", "size", "list", "low", "high"]
        keys = list(zip(*(group.column(n).to_pylist() for n in names)))
        order = sorted(range(len(keys)), key=keys.__getitem__)
        reps, copies, part = (group.column(n).to_numpy() for n in ("rep", "copies", "part"))
        out: list[tuple] = []
        first = 0
        while first < len(order):
            key, last = keys[order[first]], first
            while last < len(order) and keys[order[last]] == key:
                last += 1
            at = np.array(order[first:last])
            at = at[np.argsort(reps[at])]
            first = last
            if len(at) < 2:
                continue
            taken = group.select(["embedding", "near"]).take(pa.array(at))
            units = _units(_rows_of(taken.column("embedding").combine_chunks()))
            near = taken.column("near").combine_chunks().flatten().to_numpy().reshape(len(at), -1)
            _, _, here, low, high = key
            left = np.flatnonzero(part[at] == low)
            right = left if low == high else np.flatnonzero(part[at] == high)
            found = []
            for begin in range(0, len(left), 512):
                rows = left[begin : begin + 512]
                i, j = linked(near[rows], near[right], units[rows], units[right], here, shared, threshold)
                i, j = rows[i], right[j]
                found.append((i[i < j], j[i < j]) if low == high else (i, j))
            i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (np.zeros(0, int),) * 2
            if not len(i):
                continue
            weight, here_reps = copies[at], reps[at]
            links = np.bincount(i, weight[j], len(at)).astype(np.int64) + np.bincount(j, weight[i], len(at)).astype(np.int64)
            root = _roots(len(at), i, j)
            out += zip(here_reps[links > 0].tolist(), here_reps[root[links > 0]].tolist(), links[links > 0].tolist())
        columns = list(zip(*out)) or [[], [], []]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "root", "links"])

    return run


def near_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    prefix: int = PREFIX,
    shared: int = SHARED,
    drawn: int | None = None,
    block: int = BLOCK,
    bucket: int = BUCKET,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per id of ``vectors`` (vec_id, embedding, label).

    Two vectors link when their labels are equal and the cosine of the two, in double precision, is
    ``threshold`` or more. ``n_links`` counts the other vectors linked directly, ``component_id`` is the
    smallest id reachable by links, and the vector of that id is kept.

    1. Copies (equal label and components) become one row with their number, by partial sums.
    2. Reference points are a sample, ``DRAWN`` times the square root of the number of vectors (never over
       ``MOST``); every vector is described and listed. The lists then hold some ``PREFIX`` times the square
       root of that number of vectors each, so comparisons grow with its power 1.5.
    3. A list of more than ``block`` vectors is cut into parts, and each pair of parts is compared by itself.
       A comparison returns a row per vector, never its pairs.

    A link is found if the pair shares ``shared`` reference points; whether it does is measured against
    brute force in the tests. No candidate is left out for any other reason.

    Vectors that are null, empty, zero or hold null, NaN or infinite components, null labels and null ids
    link with nothing and stay. Vectors of different length do not link. Of rows that repeat an id the
    least (label, embedding) counts; null ids are one row. An empty table gives no rows; extra columns are
    not read.
    """
    rows = shipped(vectors).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("string").alias("label"), F.col("embedding")).alias("v")
    )
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.embedding")
    number = lambda x: x.cast("double")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: number(x) != 0)
    digest = F.unhex(F.sha2(F.to_json(F.struct("label", "embedding")), 256))
    rows = settle(rows.withColumn("key", F.when(takes_part, digest)))

    held = rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    held = settle(held.withColumn("size", F.size("embedding")))
    n = held.count()
    points = references(held, drawn or min(MOST, max(FEWEST, int(DRAWN * n**0.5))))

    described = held.select("label", "size", "rep", "copies", "embedding")
    kind = described.schema["embedding"].dataType.simpleString()
    described = settle(described.mapInArrow(_describe(points, prefix), f"label string, size int, rep long, copies long, embedding {kind}, near array<int>"))
    seen = described.select("size", F.explode("near").alias("p")).groupBy("size", "p").count().collect()  # at most one row per point
    place = {size: np.arange(len(held_points)) for size, held_points in points.items()}
    for size, held_points in points.items():
        counts = np.zeros(len(held_points), np.int64)
        for row in seen:
            if row["size"] == size:
                counts[row["p"]] = row["count"]
        place[size][np.argsort(counts, kind="stable")] = np.arange(len(counts))

    listed = _listed(place, shared)
    lists = described.select("label", "size", "near").mapInArrow(listed, "label string, size int, near array<int>, list int")
    lists = settle(lists.groupBy("label", "size", "list").count())
    long = lists.where(F.col("count") > block).select("label", "size", "list", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    entries = described.mapInArrow(listed, f"label string, size int, rep long, copies long, embedding {kind}, near array<int>, list int")
    entries = lookup_join(entries, long, ["label", "size", "list"])
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    entries = entries.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("parts", "other")
    groups = max(shuffle_width(vectors), -(-n * (prefix - shared + 1) // bucket))
    goes = F.pmod(F.xxhash64("label", "size", "list", "low", "high"), F.lit(groups))
    found = settle(entries.withColumn("goes", goes).groupBy("goes").applyInArrow(_verify(shared, threshold), "rep long, root long, links long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = held.select("key", "rep", "copies").join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = settle(
        classes.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    result = lookup_join(rows.select("vec_id", "key"), classes, ["key"])
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


@query(
    "op12_pivot_near_vectors",
    "WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL "
    "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id "
    "WHERE list_cosine_similarity(a.e, b.e) >= 0.98), "
    "reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b), "
    "n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a) "
    "SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN n ON n.a = c.a",
)
def op12(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
