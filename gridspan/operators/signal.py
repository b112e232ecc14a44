"""Binned summaries of a signal over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import coordinate_columns
from ..plans.joins import fits_broadcast
from .region import overlap_join


def tree_nodes(first: Column, last: Column, levels: int) -> Column:
    """The nodes (level, at) of a binary tree over bins that are just the bins [first, last).

    A node of level l and place ``at`` holds the bins from at * 2**l on. At most two nodes of a level are needed,
    so an interval is as many rows as the tree has levels, not as it has bins.
    """

    def of_level(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        low, high = F.call_function("div", first + size - 1, size), F.call_function("div", last, size)
        node = lambda at: F.struct(level.alias("level"), at.alias("at"))
        there = low < high
        return F.array(F.when(there & (low % 2 == 1), node(low)), F.when(there & (high % 2 == 1), node(high - 1)))

    nodes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))
    return F.filter(nodes, lambda x: x.isNotNull())


def binned_signal(
    signal: DataFrame,
    windows: DataFrame,
    n: int,
    value: str = "value",
    columns: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Mean, min and max of the covered bases and the covered share, for ``n`` bins per window.

    Bin ``i`` starts at ``start + floor(length * i / n)``; a window shorter than ``n`` bases has
    one bin per base. An empty bin has nulls and coverage 0. ``windows`` has chrom, start, end
    and a unique ``window_id``; its ends are closed numbers.

    An interval gives a row for its first and its last bin and one per tree node for the bins between, which
    it covers whole; sums, minima and maxima of the nodes are pushed down to their bins once per window.
    """
    chrom, start, end = coordinate_columns(signal, columns)
    size = F.col("end") - F.col("start")
    wins = windows.select("chrom", "start", "end", "window_id").where(size > 0)
    wins = wins.withColumn("n_bins", F.least(F.lit(n).cast("long"), size))
    narrow = signal.select(chrom, start, end, F.col(value).cast("double").alias("_v"))
    narrow = narrow.where("_v IS NOT NULL")
    met = overlap_join(narrow, wins, "per_window", (chrom, start, end))

    ws, bins = F.col("window_start"), F.col("window_n_bins")
    length = F.col("window_end") - ws
    low, high = F.greatest(F.col(start), ws), F.least(F.col(end), F.col("window_end"))
    # the bin of base x is the largest i with floor(length * i / bins) <= x - start
    bin_of = lambda x: F.floor(((x - ws + 1) * bins - 1) / length)
    met = met.where(low < high).withColumns({"_low": low, "_high": high})
    edge = lambda i: ws + F.floor(length * i / bins)
    first, last = bin_of(F.col("_low")), bin_of(F.col("_high") - 1)
    cover = lambda i: F.least("_high", edge(i + 1)) - F.greatest("_low", edge(i))
    part = lambda i: F.struct(F.lit(0).alias("level"), i.alias("at"), cover(i).alias("cover"))
    ends = F.filter(F.array(part(first), F.when(last > first, part(last))), lambda x: x.isNotNull())
    whole = F.transform(tree_nodes(first + 1, last, max(n, 1).bit_length()), lambda x: F.struct(x["level"], x["at"], F.lit(None).cast("long").alias("cover")))
    rows = met.select("window_id", ws.alias("_ws"), length.alias("_length"), bins.alias("_bins"), "_v", F.inline(F.concat(ends, whole)))
    nodes = rows.groupBy("window_id", "level", "at").agg(
        F.sum(F.col("_v") * F.col("cover")).alias("_parts"),
        F.sum("cover").alias("_part_bases"),
        F.sum(F.when(F.col("cover").isNull(), F.col("_v"))).alias("_whole"),
        F.count(F.when(F.col("cover").isNull(), 1)).alias("_wholes"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        *[F.first(c).alias(c) for c in ("_ws", "_length", "_bins")],
    )
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    reach = F.sequence(F.col("at") * size, F.least((F.col("at") + 1) * size, F.col("_bins")) - 1)
    pushed = nodes.withColumn("bin", F.explode(reach))
    at = lambda i: F.floor(F.col("_length") * i / F.col("_bins"))
    bases = at(F.col("bin") + 1) - at(F.col("bin"))
    none = F.lit(0)
    sums = (
        pushed.groupBy("window_id", "bin")
        .agg(
            F.sum(F.coalesce("_parts", none) + F.coalesce("_whole", none) * bases).alias("_sum"),
            F.sum(F.coalesce("_part_bases", none) + F.col("_wholes") * bases).alias("_bases"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        .withColumn("mean", F.col("_sum") / F.col("_bases"))
        .drop("_sum")
    )
    slots = wins.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)))
    edge = lambda i: F.col("start") + F.floor((F.col("end") - F.col("start")) * i / F.col("n_bins"))
    slots = slots.select(
        "window_id", "chrom", "bin", edge(F.col("bin")).alias("start"), edge(F.col("bin") + 1).alias("end")
    )
    joined = slots.join(F.broadcast(sums) if fits_broadcast(slots) else sums, ["window_id", "bin"], "left")
    coverage = F.coalesce("_bases", F.lit(0)) / (F.col("end") - F.col("start"))
    return joined.select("window_id", "chrom", "start", "end", "bin", "mean", "min", "max", coverage.alias("coverage"))


def chromosome_windows(lengths: DataFrame) -> DataFrame:
    """One window per chromosome from (name, length); the id is the hash of the name."""
    return lengths.where("length > 0").select(
        F.col("name").alias("chrom"),
        F.lit(0).cast("long").alias("start"),
        F.col("length").cast("long").alias("end"),
        F.xxhash64("name").alias("window_id"),
    )
