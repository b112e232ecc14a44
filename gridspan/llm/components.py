"""Connected components of a link table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


# Rows of a few numbers that one task takes.
_TASK_ROWS = 500_000


def tasks(rows: int) -> int:
    """Tasks for a table of ``rows`` rows of a few numbers: not more than its rows ask for.

    Every shuffle writes files for each of its tasks, so that the rounds over a small table would cost as much as
    those over a large one.
    """
    return max(8, -(-rows // _TASK_ROWS))


def _stars(pairs: DataFrame, low: bool, width: int) -> DataFrame:
    """One step: every node hands its larger (or, with ``low``, its smaller) neighbours to its smallest.

    ``pairs`` has rows (a, b) with a < b, each once. A node's neighbours are joined to the node's minimum
    by a shuffle join, which Spark splits where a node has very many; minima come from partial sums.
    """
    if low:
        turned = pairs.select(F.col("b").alias("node"), F.col("a").alias("near"))
    else:
        turned = pairs.select(F.col("a").alias("node"), F.col("b").alias("near")).unionAll(pairs.select("b", "a"))
    least = turned.groupBy("node").agg(F.min("near").alias("m"))
    if low:
        joined = turned.join(least, "node")
        moved = joined.select(F.col("near").alias("x"), F.col("m").alias("y")).unionAll(least.select("node", "m"))
    else:
        joined = turned.where("near > node").join(least, "node")
        moved = joined.select(F.col("near").alias("x"), F.least("node", "m").alias("y"))
    moved = moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return moved.coalesce(width).distinct().coalesce(width)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the component's smallest node.

    Large-star and small-star steps in turn until the links no longer change; each round is settled, so
    lost executors cost one round. The number of rounds grows with the logarithm of a component's size.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs, mark = settle(pairs), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark, width = now, tasks(now[0])
        # the links never become more
        pairs = settle(_stars(_stars(pairs.coalesce(width), low=False, width=width), low=True, width=width))
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(pairs.select(F.col("a").alias("node"), "a").distinct())
