"""Small inputs over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPLIT = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores before work that is heavy per row.

    A file with one row group is one task, however many cores wait. An input of as many files
    as cores, or of as many split-sized pieces, spreads by itself and is left alone, so at
    scale this adds no shuffle. Row order is not kept.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0] or 0
    return df.repartition(cores) if size < cores * _SPLIT else df
