"""Joins whose plan depends on checked sizes, not on hope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of the bytes of one row: 16 per fixed-width cell, the text for the rest."""
    sizes = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) + 16)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.to_json(F.struct(column))
            sizes.append(2 * F.coalesce(F.octet_length(text), F.lit(0)) + 16)
        else:
            sizes.append(F.lit(16))
    return reduce(lambda a, b: a + b, sizes).cast("long")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small: one job that stops reading after ``rows + 1`` rows."""
    seen, used = (
        df.select(_row_bytes(df).alias("b"))
        .limit(rows + 1)
        .agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0)))
        .first()
    )
    return seen <= rows and used <= size


def small_side(table: DataFrame) -> DataFrame:
    """Settle a summary table, with the hint to broadcast it if it is proven small.

    For tables with a row per file, split or partition: the pass that makes them runs once, and
    the large side of the join that follows is shuffled only when they are too many.
    """
    table = settle(table)
    return F.broadcast(table) if fits_broadcast(table) else table


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join ``rows`` to a ``table`` that holds each key once.

    A table proven small is broadcast. Otherwise the hottest keys of ``rows`` (a fixed
    number of them, so their table rows have a proven bound) are joined by broadcast and
    never shuffled; the rest is shuffled, and no key left in it can hold more than one
    part in ``HOT_KEYS`` of the rows. Rows with a null key match nothing and go nowhere.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join is a left or an inner join")
    if fits_broadcast(table):
        return rows.join(F.broadcast(table), on, how)

    order = rows.columns + [c for c in table.columns if c not in on]
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    hot = (
        rows.where(keyed)
        .groupBy(*on)
        .count()
        .orderBy(F.desc("count"), *on)
        .limit(HOT_KEYS)
        .select(*on)
    )
    hot_table = table.join(F.broadcast(hot), on, "left_semi")
    pieces = [
        rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(hot_table), on, how),
        rows.where(keyed).join(F.broadcast(hot), on, "left_anti").join(table, on, how),
    ]
    if how == "left":
        gaps = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in on]
        pieces.append(rows.where(~keyed).select("*", *gaps))
    return reduce(DataFrame.unionByName, [p.select(*order) for p in pieces])


def member_join(rows: DataFrame, members: DataFrame, on: list[str], keep: bool) -> DataFrame:
    """Rows whose key is (``keep``) or is not among the members; a null key is in neither.

    Members proven small are broadcast; others go through :func:`lookup_join`, so that a key
    with many rows is not one task.
    """
    members = members.select(*on).distinct()
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    rows = rows.where(present)
    if fits_broadcast(members):
        return rows.join(F.broadcast(members), on, "left_semi" if keep else "left_anti")
    marked = lookup_join(rows, members.withColumn("_member", F.lit(True)), on, "inner" if keep else "left")
    return (marked if keep else marked.where("_member IS NULL")).drop("_member")
