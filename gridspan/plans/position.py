"""Source order as columns: Spark has none, so operators that need it carry it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle
from .joins import small_side

POS = "_pos"
# Bytes of text that a task takes after a shuffle.
TASK_BYTES = 16 << 20
_IN_PARTITION = (1 << 33) - 1


def parquet_rows(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan with ``_pos`` = (file, row in the file), read from file metadata."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    return df.select(*(columns or ["*"]), place.alias(POS))


def _pin_splits(spark: SparkSession) -> None:
    """Make every scan of this session cut and pack its files the same way.

    Unless this is set, the size of a split follows the number of cores at that moment, which
    changes when executors come and go; line order taken from splits must not change with it.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files as (file, at, line); ``at`` orders the lines of a file.

    ``at`` is the split and the running id in it, so it costs no pass of its own; where the
    number of the line is wanted, use :func:`text_lines`.
    """
    _pin_splits(spark)
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id")
        ).alias("at"),
        F.col("value").alias("line"),
    )


def text_lines(spark: SparkSession, path, line_sep: str | None = None) -> DataFrame:
    """Lines of text files as (file, line_no, line), line_no dense from 0 within a file.

    Every line of a split is read by one task in file order, so the running id of the
    partition orders the lines of the split; a table with one row per split supplies the
    offset. No line passes through Python and no file needs to fit one task.
    """
    lines, splits = _placed_lines(spark, path, line_sep)
    return lines.join(splits, ["file", "_split"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def lines_by_file_number(spark: SparkSession, path, line_sep: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The same lines as (file_no, line_no, line), the table (file_no, file), and how many tasks they need.

    For lines that are shuffled: a path is often longer than a line, so they carry the number of their file, and
    they are dealt to tasks that become more with the bytes of the files, so that no task grows with them.
    """
    lines, splits = _placed_lines(spark, path, line_sep)
    numbers = Window.orderBy("file")
    splits = small_side(splits.withColumn("file_no", F.dense_rank().over(numbers)))
    total = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-total // TASK_BYTES), spark.sparkContext.defaultParallelism)
    numbered = lines.join(splits, ["file", "_split"]).select("file_no", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")
    return numbered, splits.select("file_no", "file").distinct(), tasks


def _placed_lines(spark: SparkSession, path, line_sep: str | None) -> tuple[DataFrame, DataFrame]:
    """Lines with their split and running id, and the shift from that to the line number, a row per split."""
    _pin_splits(spark)
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    raw = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    splits = raw.groupBy("file", "_split").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(
        "file", "_split", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return raw, small_side(splits)


def numbered_parquet(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """A Parquet scan with ``_row``: the dense position over all files, in path order.

    Offsets come from one count per file, which the scan answers from row metadata.
    """
    rows = parquet_rows(spark, path, columns)
    files = rows.groupBy(F.col(f"{POS}.file").alias("_file")).count()
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    names = [c for c in rows.columns if c != POS]
    return (
        rows.withColumn("_file", F.col(f"{POS}.file"))
        .join(small_side(files), "_file")
        .select(*names, (F.col("_offset") + F.col(f"{POS}.row")).alias("_row"))
    )


def numbered_by(df: DataFrame, keys: list[Column | str], name: str = "_row") -> DataFrame:
    """Add the dense rank of each row under a total order, for data of any size.

    The sorted frame is settled once; the rank is the row's place in its partition plus
    the rows of the partitions before it (one row per partition).
    """
    placed = settle(df.orderBy(*keys)).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    parts = placed.groupBy("_part").count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # settled, or every later pass would count all rows again
    parts = settle(parts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")))
    rank = F.col("_offset") + F.col("_id").bitwiseAND(F.lit(_IN_PARTITION))
    return placed.join(F.broadcast(parts), "_part").select(*df.columns, rank.alias(name))
