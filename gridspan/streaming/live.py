"""The same operators on a growing directory.

Stateless operators (filters, select, compute, flatten, expand with known keys, genotype
statistics, pileup decoding, region filters) take a streaming frame as it is. The functions
here are the ones whose streaming form differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.cells import FLOATS, column_type, is_number, text_of
from ..operators.select import require


def read_growing(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """A stream of the files that arrive below ``path``."""
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def chain(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply frame-to-frame steps in order, to a stream or a batch."""
    for step in steps:
        df = df.transform(step)
    return df


def live_value_counts(df: DataFrame, columns: list[str], total: bool = False) -> DataFrame:
    """Running column, value, count; for output mode complete or update.

    State is one row per distinct value. With ``total`` the rows are counted as well, under no column: the
    total that shares are taken of is then part of every result (see :func:`shares_of`).
    """
    require(df, *columns)
    cells = [F.struct(F.lit(c).alias("column"), text_of(df, c).alias("value")) for c in columns]
    if total:
        cells.append(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("value")))
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("*").alias("count"))


def shares_of(counts: DataFrame) -> DataFrame:
    """column, value, count, fraction from counts that hold their total."""
    total = counts.where("column IS NULL").agg(F.max("count")).scalar()
    return counts.where("column IS NOT NULL").select("column", "value", "count", (F.col("count") / total).alias("fraction"))


def live_describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Running count, nulls, min, max, mean and std per numeric column: one state row each."""
    require(df, *columns)
    cells = []
    for c in columns:
        kind = column_type(df, c)
        if not is_number(kind):
            raise ValueError(f"{c!r} is not a number")
        value = F.col(f"`{c}`").cast("double")
        finite = F.when(~F.isnan(value), value) if isinstance(kind, FLOATS) else value
        cells.append(F.struct(F.lit(c).alias("column"), value.alias("v"), finite.alias("f")))
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column")
        .agg(
            F.count("v").alias("count"),
            F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"),
            F.min("f").alias("min"),
            F.max("f").alias("max"),
            F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std"),
        )
    )


def live_distinct(df: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first arrival of each key. With a time column, keys are forgotten after ``delay``, so
    the state stays bounded; without one every key is kept."""
    require(df, *keys)
    if time is None:
        return df.dropDuplicates(keys)
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append what has arrived to files, exactly once, and stop."""
    return (
        df.writeStream.format(fmt)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )


# Batches whose changes are read beside the base before they are put together.
COMPACT = 16


def write_totals(df: DataFrame, path: str, checkpoint: str, keys: list[str], compact: int = COMPACT) -> StreamingQuery:
    """Keep the running result of an aggregation with one row per ``keys``, for :func:`read_totals`.

    A batch writes the rows it changed, in a folder of its number, and then publishes the number; every
    ``compact`` batches the latest rows are put together in a new base first. Nothing that was published is
    ever written again: a batch that comes twice is left as it is if it was published and replaced if it was
    not. So a reader sees the result after one batch or after the next, whenever the writer stops.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = _published(spark, path)
        if version is not None and version[0] >= number:
            # it is run, so that the state of the stream is written
            batch.write.format("noop").mode("overwrite").save()
            return
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        base = version[1] if version is not None else -1
        if number - base >= compact:
            _latest(spark, path, number, base, keys).write.mode("overwrite").parquet(f"{path}/base/batch={number}")
            base = number
        _publish(spark, path, number, base)

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(merge)
        .start()
    )


def _publish(spark: SparkSession, path: str, number: int, base: int) -> None:
    spark.createDataFrame([(number, base)], _VERSION).coalesce(1).write.mode("overwrite").json(f"{path}/versions/{number}")


_VERSION = "batch long, base long"


def _published(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """The last published batch, and the batch of the base it stands on (-1: none)."""
    try:
        versions = spark.read.schema(_VERSION).option("recursiveFileLookup", "true").json(f"{path}/versions")
        last = versions.agg(F.max(F.struct("batch", "base")).alias("v")).first()["v"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if last is None else (last["batch"], last["base"])


def _latest(spark: SparkSession, path: str, number: int, base: int, keys: list[str]) -> DataFrame:
    """The last row of each key up to a batch: the base and the changes since."""
    rows = spark.read.parquet(f"{path}/changes").where((F.col("batch") > base) & (F.col("batch") <= number))
    columns = [c for c in rows.columns if c != "batch"]
    if base >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/base/batch={base}").withColumn("batch", F.lit(base)))
    # a key has one row in a batch
    last = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "batch").alias("_row"))
    return last.select("_row.*")


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The result of :func:`write_totals` after the last published batch."""
    version = _published(spark, path)
    if version is None:
        raise ValueError(f"nothing is published in {path}")
    return _latest(spark, path, *version, keys)
