"""Copies of rows, and tables put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import require


def first_of_copies(df: DataFrame, columns: list[str], position: str) -> DataFrame:
    """The position of the first of each group of equal rows, and how many there are.

    Rows are grouped by the SHA-256 of their cells, so the shuffle moves one short digest per
    distinct row and task instead of the text.
    """
    require(df, position, *columns)
    cells = [F.col(f"`{c}`") for c in columns]
    digest = F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256)
    return (
        df.select(digest.alias("_digest"), F.col(f"`{position}`"))
        .groupBy("_digest")
        .agg(F.min(position).alias(position), F.count("*").alias("copies"))
        .drop("_digest")
    )


def concatenate(tables: dict[str, DataFrame], label: str = "cell") -> DataFrame:
    """Same-schema tables one after the other, each row led by the name of its table."""
    labelled = [df.select(F.lit(name).alias(label), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, labelled)
