"""Sorting, first and last rows, samples and distinct rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import column_type, is_number, text_of
from ..plans.quantiles import first_rows
from .select import require

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)


def sort_key(df: DataFrame, key: str) -> Column:
    """``name`` or ``name:desc``; nulls last either way, NaN before them; nested by text."""
    name, _, direction = key.rpartition(":") if key.endswith((":desc", ":asc")) else (key, "", "asc")
    require(df, name)
    cell = F.col(f"`{name}`")
    if isinstance(column_type(df, name), _NESTED):
        cell = text_of(df, name)
    return cell.desc_nulls_last() if direction == "desc" else cell.asc_nulls_last()


def sort_columns(df: DataFrame, keys: list[str]) -> list[Column]:
    """The ordering of several keys; a float key puts nulls last and NaN before them."""
    columns = []
    for key in keys:
        name = key.rsplit(":", 1)[0] if key.endswith((":desc", ":asc")) else key
        require(df, name)
        if is_number(column_type(df, name)) and column_type(df, name).typeName() in ("double", "float"):
            cell = F.col(f"`{name}`")
            columns += [cell.isNull().asc(), F.isnan(cell).asc()]
        columns.append(sort_key(df, key))
    return columns


def sort(df: DataFrame, keys: list[str], ties: list[Column | str] = ()) -> DataFrame:
    """Order by several keys; ``ties`` (source position or a unique key) makes it stable.

    Spark range-partitions on all of the keys, so with a unique tie key one frequent value
    spreads over as many tasks as its rows need.
    """
    return df.orderBy(*sort_columns(df, keys), *ties)


def top(df: DataFrame, keys: list[str], k: int, ties: list[Column | str] = ()) -> DataFrame:
    """The first ``k`` rows of the sort: a top-k per task, not a sort of the table."""
    return sort(df, keys, ties).limit(k)


def head(df: DataFrame, n: int, position: Column | None = None) -> DataFrame:
    """The first ``n`` rows; exact when a position (a long) is given, else as scanned."""
    return df.limit(n) if position is None else first_rows(df, [position], n).orderBy(position)


def tail(df: DataFrame, n: int, position: Column) -> DataFrame:
    """The last ``n`` rows by position, in source order."""
    return first_rows(df, [-position], n).orderBy(position)


def sample(df: DataFrame, n: int, position: list[Column | str], seed: int = 0) -> DataFrame:
    """``n`` rows, each set equally likely, without replacement, in source order.

    The draw is a hash of the seed and the row's position, so it is the same on every run and
    after a lost executor, whatever the partitioning. The hash is cut to 31 bits for the exact
    cut by counting; the full hash and the position order its ties.
    """
    # two rounds of hashing: rows with near positions get unrelated draws
    draw = F.xxhash64(F.xxhash64(*position), F.lit(seed))
    short = F.shiftrightunsigned(draw, 33)
    return first_rows(df, [short, draw, *position], n).orderBy(*position)


def distinct(df: DataFrame, columns: list[str] | None = None, position: Column | None = None) -> DataFrame:
    """Distinct rows over the chosen columns, which are all that is kept.

    With a position the first occurrence of each is kept in source order, its position used
    for nothing but that. Nulls are equal, NaNs are equal, and nested cells compare by text.
    Copies collapse in the map-side aggregation, so a frequent row costs one row per task.
    """
    names = columns or df.columns
    require(df, *names)
    keys = []
    for c in names:
        kind = column_type(df, c)
        keys.append((text_of(df, c) if isinstance(kind, (T.MapType, T.VariantType)) else F.col(f"`{c}`")).alias(c))
    carried = [c for c in names if isinstance(column_type(df, c), (T.MapType, T.VariantType))]
    if position is None and not carried:
        return df.select(*keys).distinct()
    place = position if position is not None else F.lit(0)
    grouped = df.select(*keys, place.alias("_place"), *[F.col(f"`{c}`").alias(f"_{c}") for c in carried])
    grouped = grouped.groupBy(*[F.col(f"`{c}`") for c in names]).agg(
        F.min("_place").alias("_first"), *[F.min_by(f"`_{c}`", "_place").alias(f"_{c}") for c in carried]
    )
    out = [F.col(f"`_{c}`").alias(c) if c in carried else F.col(f"`{c}`") for c in names]
    if position is not None:
        grouped = grouped.orderBy("_first")
    return grouped.select(*out)
