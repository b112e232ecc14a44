"""Sorted-interval tables: running maximum of End, order checks, validation, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import INTEGERS, column_type
from ..functions.coords import coordinate_columns
from ..plans.joins import lookup_join
from ..plans.scan import fullest_block, prefix_scan
from ..session import settle

REACH = "MaxEndSoFar"
# Rows of one chromosome within a block of coordinates that one window may hold.
CROWD = 1 << 20


def running_max_end(
    df: DataFrame, columns: tuple[str, str, str] | None = None, name: str = REACH
) -> DataFrame:
    """Add the largest End so far per chromosome in (Start, End) order.

    The scan runs over the rows themselves, in blocks of coordinates, where no block holds more than ``CROWD``
    rows. Otherwise it runs over one row per distinct start, and each row takes the larger of its End and
    the maximum before its start, as rows that share a start differ only in their own End. No window holds
    a chromosome. A row without chromosome or start takes its End.
    """
    chrom, start, end = coordinate_columns(df, columns)
    fullest, unplaced = fullest_block(df, [chrom], start)
    if fullest <= CROWD:
        placed = df.where(F.col(chrom).isNotNull() & F.col(start).isNotNull()) if unplaced else df
        scanned = prefix_scan(placed, [chrom], start, {"_reach": ("max", F.col(end))}, then=[end])
        # null while no row so far has an End
        scanned = scanned.select(*df.columns, F.col("_reach").alias(name))
        if not unplaced:
            return scanned
        rest = df.where(F.col(chrom).isNull() | F.col(start).isNull())
        return scanned.unionByName(rest.select(*df.columns, F.col(end).alias(name)))

    starts = df.groupBy(F.col(chrom), F.col(start)).agg(F.max(end).alias("_top"))
    starts = starts.where(F.col(chrom).isNotNull() & F.col(start).isNotNull())
    scanned = prefix_scan(starts, [chrom], start, {"_reach": ("max_before", F.col("_top"))})
    # the size check and the join both read it
    scanned = settle(scanned.select(chrom, start, "_reach"))
    joined = lookup_join(df, scanned, [chrom, start])
    return joined.select(*df.columns, F.greatest(F.col(end), F.col("_reach")).alias(name))


def out_of_order(df: DataFrame, position: str, columns: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows whose (Start, End) is below that of the row before on the same chromosome, in
    source order; ``position`` is a dense long."""
    chrom, start, end = coordinate_columns(df, columns)
    here = F.struct(F.col(start).alias("s"), F.col(end).alias("e"))
    kept = df.where(F.col(chrom).isNotNull())
    scanned = prefix_scan(kept, [chrom], position, {"_before": ("lag", here)})
    return scanned.where(F.col("_before").isNotNull() & (here < F.col("_before"))).drop("_before")


def _examples(bad: DataFrame, text, position: str, n: int = 5) -> tuple[int, str | None]:
    """How many rows are bad and the first few as text."""
    total = bad.count()
    if not total:
        return 0, None
    shown = bad.orderBy(position).limit(n).select(text.alias("t")).collect()
    return total, "; ".join(r["t"] for r in shown)


def chromosome_blocks(df: DataFrame, position: str, columns: tuple[str, str, str] | None = None) -> DataFrame:
    """(chrom, row_offset, n_rows): where the rows of each chromosome lie in a sorted table, a row per chromosome."""
    chrom, _, _ = coordinate_columns(df, columns)
    first, n = F.min(position).alias("row_offset"), F.count("*").alias("n_rows")
    return df.groupBy(F.col(chrom).cast("string").alias("chrom")).agg(first, n)


def _block_checks(df: DataFrame, total: int, position: str, chrom: str, blocks: DataFrame, report) -> None:
    """Whether blocks written beside a table hold every row once, and each row has the chromosome of its block.

    A chromosome has one block, so a row is right if it lies in the block of its own chromosome; no row is
    compared with the blocks of others. ``total`` is the number of rows.
    """
    blocks = settle(blocks.select(F.col("chrom").cast("string").alias("chrom"), "row_offset", "n_rows"))
    # a row per chromosome
    before = F.lag(F.col("row_offset") + F.col("n_rows"), 1, 0).over(Window.orderBy("row_offset", "chrom"))
    apart = blocks.withColumn("_before", before).where("row_offset <> _before OR n_rows < 0")
    text = F.concat(F.coalesce("chrom", F.lit("null")), F.lit(" begins at row "), F.col("row_offset").cast("string"))
    wrong, shown = _examples(apart, text, "row_offset")
    held = blocks.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    if total != held:
        wrong, shown = wrong + 1, "; ".join(filter(None, [shown, f"{held} rows in blocks, {total} in the table"]))
    report("the blocks hold every row once", wrong, shown)

    single = blocks.groupBy("chrom").agg(F.min("row_offset").alias("_first"), F.min(F.col("row_offset") + F.col("n_rows")).alias("_end"))
    rows = df.select(F.col(chrom).cast("string").alias("_chrom"), position)
    placed = lookup_join(rows, single.withColumnRenamed("chrom", "_chrom"), ["_chrom"])
    inside = (F.col(position) >= F.col("_first")) & (F.col(position) < F.col("_end"))
    text = F.concat(F.lit("row "), F.col(position).cast("string"), F.lit(": "), F.coalesce("_chrom", F.lit("null")))
    outside = settle(placed.where(~F.coalesce(inside, F.lit(False))).select("_chrom", position))
    report("every row has the chromosome of its block", *_examples(outside, text, position))


def validate_intervals(
    df: DataFrame,
    position: str,
    columns: tuple[str, str, str] | None = None,
    reach: str = REACH,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """PASS / FAIL per invariant of a sorted-interval table: check, status, violations, examples.

    ``position`` is the dense row position. Null coordinates are reported, not an error. With ``blocks``, which
    tell where each chromosome's rows lie (see :func:`chromosome_blocks`), two checks against them come last.
    """
    spark = df.sparkSession
    schema = "check string, status string, violations long, examples string"
    rows: list[tuple] = []

    def report(check: str, violations: int, examples: str | None = None) -> None:
        rows.append((check, "FAIL" if violations else "PASS", violations, examples))

    try:
        chrom, start, end = coordinate_columns(df, columns)
    except ValueError as problem:
        report("coordinate columns present", 1, str(problem))
        return spark.createDataFrame(rows, schema)
    kind = column_type(df, chrom).simpleString()
    report(f"{chrom} is text", int(kind != "string"), kind if kind != "string" else None)
    for name in (start, end, reach):
        kind = column_type(df, name) if name in df.columns else None
        good = isinstance(kind, INTEGERS)
        report(f"{name} is a whole number", int(not good), None if good else str(kind))
    if any(r[1] == "FAIL" for r in rows):
        return spark.createDataFrame(rows, schema)

    c, s, e = F.col(chrom), F.col(start), F.col(end)
    at = F.concat(F.lit("row "), F.col(position).cast("string"))
    whole = c.isNotNull() & s.isNotNull() & e.isNotNull()
    at_whole = F.when(whole, F.col(position))
    # a row per chromosome
    extent = settle(df.groupBy(c.alias("chrom")).agg(
        F.min(at_whole).alias("first"), F.max(at_whole).alias("last"), F.count(F.when(whole, 1)).alias("n"), F.count(F.when(~whole, 1)).alias("gaps")
    ))
    empty, total = extent.agg(F.coalesce(F.sum("gaps"), F.lit(0)), F.coalesce(F.sum(F.col("n") + F.col("gaps")), F.lit(0))).first()
    report("no null coordinates", *(_examples(df.where(~whole), at, position) if empty else (0, None)))
    good = df.where(whole)

    # null rows inside a block are reported above and leave gaps here, so they count as its rows
    apart = extent.where("chrom IS NOT NULL AND last - first + 1 > n + gaps")
    text = F.concat("chrom", F.lit(" rows "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    report("each chromosome is one block", *_examples(apart, text, "first"))

    # one scan answers both; only bad rows are kept, to be counted and shown
    here = F.struct(s.alias("s"), e.alias("e"))
    scanned = prefix_scan(good, [chrom], position, {"_before": ("lag", here), "_top": ("max", e)})
    below = F.coalesce(here < F.col("_before"), F.lit(False))
    wrong = ~F.col(reach).eqNullSafe(F.col("_top"))
    names = list(dict.fromkeys([chrom, start, end, reach, position]))
    bad = settle(scanned.select(*names, "_top", below.alias("_below"), wrong.alias("_wrong")).where("_below OR _wrong"))
    shown = F.concat(at, F.lit(" "), c, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))
    report(f"rows are sorted by ({start}, {end})", *_examples(bad.where("_below"), shown, position))
    shown = F.concat(at, F.lit(": "), F.coalesce(F.col(reach).cast("string"), F.lit("null")), F.lit(" is not "), F.col("_top").cast("string"))
    report(f"{reach} is the running maximum of {end}", *_examples(bad.where("_wrong"), shown, position))
    if blocks is not None:
        _block_checks(df, total, position, chrom, blocks, report)
    return spark.createDataFrame(rows, schema)


def sorted_layout(df: DataFrame, columns: tuple[str, str, str] | None = None) -> DataFrame:
    """Rows with ``MaxEndSoFar``, range-partitioned and sorted by (chromosome, start, end).

    Written as Parquet, each file holds a short stretch of one or a few chromosomes, and the
    statistics of start and MaxEndSoFar let a region read skip the rest.
    """
    chrom, start, end = coordinate_columns(df, columns)
    return (
        running_max_end(df, columns).repartitionByRange(chrom, start, end).sortWithinPartitions(chrom, start, end)
    )
