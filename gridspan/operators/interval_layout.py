"""Interval tables in folders by chromosome and coarse bin, whose joins with windows read only folders they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coords import coordinate_columns
from ..plans.joins import fits_broadcast, lookup_join
from ..session import settle
from .region import overlap_join

CHROM, BIN = "LayoutChrom", "LayoutBin"
# Bases of a coarse bin, as a power of two, and rows of a file.
BITS, FILE_ROWS = 20, 2_000_000
# Folders of a layout at most; each is a file at least, and listed whenever it is read.
MAX_FOLDERS = 4096


def write_layout(
    df: DataFrame, path: str, columns: tuple[str, str, str] | None = None, bits: int = BITS, file_rows: int = FILE_ROWS, mode: str = "error"
) -> None:
    """Write an interval table in folders by chromosome and the bin its rows start in.

    A table beside the data holds a row per folder with its reach: the greatest end of its rows. A bin with
    many rows is several files, each sorted by start and end. Rows without coordinates are kept in a folder
    of their own. Bins have 2**bits bases, and are doubled as often as it takes to keep to ``MAX_FOLDERS``, or
    until each chromosome is one bin either side of 0, so that folders do not become more with the table.
    """
    chrom, start, end = coordinate_columns(df, columns)
    finest = F.when(F.col(chrom).isNotNull() & F.col(end).isNotNull(), F.shiftright(F.col(start).cast("long"), bits))
    bits += _coarser(df.select(F.col(chrom).alias("c"), finest.alias("b")).where("c IS NOT NULL AND b IS NOT NULL"), bits)
    first = F.when(F.col(chrom).isNotNull() & F.col(end).isNotNull(), F.shiftright(F.col(start).cast("long"), bits))
    placed = df.withColumns({CHROM: F.when(first.isNotNull(), F.col(chrom).cast("string")), BIN: first})
    folders = placed.groupBy(CHROM, BIN).agg(F.max(F.col(end).cast("long")).alias("reach"), F.count("*").alias("rows"))
    folders = settle(folders.where(f"{CHROM} IS NOT NULL"))
    several = folders.where(F.col("rows") > file_rows).select(CHROM, BIN, F.ceil(F.col("rows") / file_rows).cast("int").alias("_files"))
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.pmod(F.xxhash64(*plain), F.coalesce("_files", F.lit(1)))
    dealt = lookup_join(placed, several, [CHROM, BIN]).withColumn("_salt", salt)
    # rows without a folder are dealt by their contents
    dealt = dealt.withColumn("_salt", F.when(F.col(CHROM).isNull(), F.pmod(F.xxhash64(*plain), F.lit(64))).otherwise(F.col("_salt")))
    dealt = dealt.repartition(CHROM, BIN, "_salt").sortWithinPartitions(CHROM, BIN, start, end).drop("_files", "_salt")
    dealt.write.mode(mode).partitionBy(CHROM, BIN).parquet(path)
    folders.select(CHROM, BIN, (F.col(BIN) * F.lit(1 << bits)).alias("start"), "reach", "rows").write.mode("overwrite").parquet(f"{path}/_reach")


def _coarser(bins: DataFrame, bits: int) -> int:
    """By how many bits bins (c, b) must be widened for ``MAX_FOLDERS``: one pass over the table, then counts of its bins."""
    bins = settle(bins.distinct())
    last = max(62 - bits, 0)
    return next((n for n in range(last) if bins.select("c", F.shiftright("b", n)).distinct().count() <= MAX_FOLDERS), last)


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a layout, with its two folder columns; chromosome names stay text whatever they look like."""
    data = spark.read.parquet(path).drop(CHROM, BIN).schema
    kinds = T.StructType([*data.fields, T.StructField(CHROM, T.StringType()), T.StructField(BIN, T.LongType())])
    return spark.read.schema(kinds).parquet(path)


def layout_overlap_join(
    spark: SparkSession, path: str, windows: DataFrame, mode: str = "per_window", columns: tuple[str, str, str] | None = None, **options
) -> DataFrame:
    """:func:`overlap_join` of a written layout with a table of windows, which reads only folders a window meets.

    Windows are joined with the table of reaches first, which has a row per folder. The folders found are one
    side of a join on the folder columns, so that Spark takes them as a filter of the scan while the query runs;
    nothing has to be known of the windows when it is planned.
    """
    data = read_layout(spark, path)
    chrom, start, end = coordinate_columns(data.drop(CHROM, BIN), columns)
    folders = spark.read.parquet(f"{path}/_reach")
    reach = F.greatest("reach", F.col("start") + 1).alias("end")
    met = overlap_join(folders.select(F.col(CHROM).alias("chrom"), "start", reach, F.col(BIN).alias("bin")), windows, "any", ("chrom", "start", "end"), options.get("alias", False))
    met = settle(met.select(F.col("chrom").alias(CHROM), F.col("bin").alias(BIN)).distinct())
    # the filter keeps all rows; Spark prunes by a side that has one
    met = met.where((F.col(BIN) > -(1 << 62)) & F.col(CHROM).isNotNull())
    kept = data.join(F.broadcast(met) if fits_broadcast(met) else met, [CHROM, BIN], "left_semi").drop(CHROM, BIN)
    return overlap_join(kept, windows, mode, (chrom, start, end), **options)
