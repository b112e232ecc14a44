"""Approximate nearest neighbours along several shifted Hilbert curves.

Vectors are projected to a few dimensions in several random ways, shifted, and ordered along a Hilbert
curve of each projection by one range-partitioned sort. A query is compared, by exact inner products,
with the vectors in a window of keys around its own place on every curve; the windows' best are merged
and ranked again.

How wide a window must be depends on the data: vectors without structure have no near neighbours in
any order of few dimensions. So the width is measured: a bounded sample of queries is answered by brute
force, and the window is the distance along the best of the curves within which ``recall`` of their
true neighbours lie. It is a share of the table, the same at every size of like data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.position import numbered_by
from ..session import settle
from .common import query, shipped, table

NEIGHBOURS = 20
CURVES = 4
DIMS = 8
BITS = 8
SAMPLE = 200
RECALL = 0.96
BLOCK = 4096
QUERY_BLOCK = 16384


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of whole numbers under 2**bits along the Hilbert curve, as signed 64-bit order."""
    x = [points[:, i].astype(np.uint64) for i in range(points.shape[1])]
    one, n = np.uint64(1), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low, bit = np.uint64(q - 1), np.uint64(q)
        for i in range(n):
            up = (x[i] & bit) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(up, low, swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(points), np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    key = np.zeros(len(points), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | (((x[i] ^ turn) >> np.uint64(b)) & one)
    return (key ^ np.uint64(1 << 63)).view(np.int64)


def projections(dimension: int, curves: int, dims: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal directions (curve, dimension, dims) and shifts (curve, dims)."""
    rng = np.random.default_rng(seed)
    dims = min(dims, dimension)
    axes = [np.linalg.qr(rng.normal(size=(dimension, dimension)))[0][:, :dims] for _ in range(curves)]
    return np.stack(axes), rng.uniform(0, 1, (curves, dims))


def _vectors(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles): rows that take part.

    Out are null ids and vectors that are null, empty, zero, hold null, NaN or infinite components, or
    have another length than most (of equally common lengths the larger counts).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _distinct(rows: DataFrame, most: int) -> DataFrame:
    """(embedding, rep, members): each vector once, with its ``most`` smallest ids.

    Copies are thinned by salted windows first, so a vector that is a third of the table is spread; of
    more than ``most`` copies no answer can hold the rest.
    """
    salted = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    thin = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    thin = thin.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= most)
    whole = thin.groupBy("embedding").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, most).alias("members"))
    return whole.select("embedding", F.element_at("members", 1).alias("rep"), "members")


def _on_curves(rows: DataFrame, kind: int, dimension: int, top: float, scale: float, curves: int, dims: int) -> DataFrame:
    """(curve, key, kind, id, vector) of every row on every curve.

    Largest inner product becomes nearest point by one more component: what a vector lacks to the largest
    length, and 0 for queries, which are stretched to that length.
    """
    axes, shifts = projections(dimension + 1, curves, dims)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            points = _vectors(batch.column(1))
            norm = np.sqrt((points * points).sum(1))
            if kind:
                lifted = np.concatenate([points * (top / norm)[:, None], np.zeros((len(points), 1))], axis=1)
            else:
                lifted = np.concatenate([points, np.sqrt(np.maximum(top * top - norm * norm, 0))[:, None]], axis=1)
            ids = batch.column(0)
            held = pa.array([v.tobytes() for v in points], pa.binary())
            for c in range(len(axes)):
                spot = (lifted @ axes[c]) / scale
                grid = np.clip((spot + 4 + shifts[c]) / 9 * (1 << BITS), 0, (1 << BITS) - 1)
                n = len(points)
                columns = [pa.array(np.full(n, c, np.int32)), pa.array(hilbert_keys(grid.astype(np.int64))), pa.array(np.full(n, kind, np.int32)), ids, held]
                yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "kind", "id", "vector"])

    return rows.mapInArrow(run, "curve int, key long, kind int, id long, vector binary")


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest of one row of scores, ties to the smaller id; ids are ascending."""
    if len(scores) > most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.flatnonzero(scores >= edge)
        some = some[np.argsort(-scores[some], kind="stable")][:most]
    else:
        some = np.argsort(-scores, kind="stable")
    return ids[some], scores[some]


def _compare(most: int):
    """Best of one block of vectors for each query that reaches it."""

    def run(base, asked):
        import pyarrow as pa

        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        names = ["query_id", "reps", "scores"]
        if not base.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        ids = base.column("id").to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        held = np.frombuffer(b"".join(base.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)[order]
        points = np.frombuffer(b"".join(asked.column("point").to_pylist()), np.float64).reshape(asked.num_rows, -1)
        reps, scores = [], []
        for first in range(0, len(points), 256):
            for row in points[first : first + 256] @ held.T:
                a, b = _best(row, ids, most)
                reps.append(a)
                scores.append(b)
        return pa.Table.from_arrays([pa.array(asked.column("query_id").to_numpy()), pa.array(reps, kinds[1]), pa.array(scores, kinds[2])], names)

    return run


def _merged(found: DataFrame, most: int) -> DataFrame:
    """(query_id, rep, score): the best ``most`` of all blocks of a query, each vector once.

    A block gives a query one row of at most ``most`` entries, so a query's group is bounded by the blocks
    it reaches.
    """
    pairs = F.transform(F.arrays_zip(F.col("reps"), F.col("scores")), lambda x: F.struct(x["reps"].alias("r"), (-x["scores"]).alias("s")))
    best = found.select("query_id", pairs.alias("p")).groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    first = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1)["r"] != x["r"]))
    best = best.select("query_id", F.transform(first, lambda x: F.struct(x["s"].alias("s"), x["r"].alias("r"))).alias("once"))
    best = best.select("query_id", F.explode(F.slice(F.array_sort("once"), 1, most)).alias("x"))
    return best.select("query_id", F.col("x.r").alias("rep"), (-F.col("x.s")).alias("score"))


def _window(placed: DataFrame, queries: DataFrame, base: DataFrame, k: int, sample: int, recall: float) -> int:
    """Ranks within which ``recall`` of a sample's true neighbours lie on their best curve.

    The sample is the ``sample`` queries with the smallest hash; all vectors are compared with it, in one
    pass that keeps the best of each batch.
    """
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    ids = np.array([r["vec_id"] for r in asked], np.int64)
    points = np.array([r["embedding"] for r in asked], np.float64).reshape(len(ids), -1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch.column(0).to_numpy()
            order = np.argsort(held)
            scores = points @ _vectors(batch.column(1))[order].T
            best = [_best(row, held[order], k + 1) for row in scores]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array([b[i] for b in best], kinds[i]) for i in (0, 1))], ["query_id", "reps", "scores"])

    found = base.select("rep", "embedding").mapInArrow(run, "query_id long, reps array<long>, scores array<double>")
    truth = settle(_merged(found, k + 1).where("query_id <> rep"))
    at = placed.where("kind = 1").join(F.broadcast(truth.select("query_id").distinct()), F.col("id") == F.col("query_id"), "left_semi")
    at = at.select(F.col("curve").alias("c"), F.col("id").alias("query_id"), F.col("rank").alias("q"))
    near = placed.where("kind = 0").join(F.broadcast(truth), F.col("id") == F.col("rep")).select("curve", "rank", "query_id", "rep")
    apart = near.join(F.broadcast(at), (F.col("curve") == F.col("c")) & (near["query_id"] == at["query_id"])).select(
        near["query_id"], "rep", F.abs(F.col("rank") - F.col("q")).alias("far")
    )
    least = apart.groupBy("query_id", "rep").agg(F.min("far").alias("far"))
    return int(least.agg(F.expr(f"percentile(far, {recall})")).first()[0] or 0)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    curves: int = CURVES,
    dims: int = DIMS,
    sample: int = SAMPLE,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest inner product found for each query.

    ``queries`` are rows of ``vectors``; a query's own row is no candidate. Scores are exact, in double
    precision; ties go to the smaller id. Curves are cut into blocks of ``block`` places; queries meet the
    blocks in their windows, many queries of one block being spread over several tasks.

    Rows that :func:`usable` leaves out take no part, as queries or as candidates. Copies of a vector are
    one point with their smallest ids, so ties among them are exact; rows that repeat an id count once;
    a query with fewer candidates than ``k`` gets all of them; an empty table gives no rows; extra columns
    are not read. Every usable row is indexed.
    """
    rows = settle(usable(shipped(vectors)).dropDuplicates(["vec_id"]))
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    base = settle(_distinct(rows, k + 1))
    seen = base.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), F.avg(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("embedding"))).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if seen[0] is None:
        return vectors.sparkSession.createDataFrame([], schema)
    top, scale, dimension = float(np.sqrt(seen[0])), float(np.sqrt(seen[1] / seen[2])), int(seen[2])

    spots = _on_curves(base.select("rep", "embedding"), 0, dimension, top, scale, curves, dims)
    spots = spots.unionAll(_on_curves(asked, 1, dimension, top, scale, curves, dims))
    placed = numbered_by(spots, ["curve", "key", "kind", "id"], "place")
    counts = base.count(), asked.count()
    each = sum(counts)
    placed = settle(placed.withColumn("rank", F.col("place") - F.col("curve") * F.lit(each)))
    reach = _window(placed, asked, base, k, sample, recall)

    last = max(0, (each - 1) // block)
    low = F.greatest(F.floor((F.col("rank") - reach) / block), F.lit(0))
    high = F.least(F.floor((F.col("rank") + reach) / block), F.lit(last))
    per_block = counts[1] * min(1.0, (2 * reach + block) / max(1, each))
    parts = int(per_block // QUERY_BLOCK) + 1
    goes = placed.where("kind = 1").select(
        F.col("curve").alias("on"),
        F.explode(F.sequence(low, high)).alias("to_block"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("to_part"),
        F.col("id").alias("query_id"),
        F.col("vector").alias("point"),
    )
    held = placed.where("kind = 0").select("curve", F.floor(F.col("rank") / block).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "vector")
    found = held.groupBy("curve", "block", "part").cogroup(goes.groupBy("on", "to_block", "to_part")).applyInArrow(_compare(k + 1), "query_id long, reps array<long>, scores array<double>")
    best = _merged(found, k + 1).join(base.select("rep", "members"), "rep").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


@query("op8_hilbert_neighbours")
def op8(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
