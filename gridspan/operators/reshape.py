"""Unpacking of nested, packed and wide columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import text_of
from ..functions.keyvalue import declared_fields, key_values, keys_of, looks_packed
from ..plans.joins import lookup_join
from ..plans.position import numbered_by
from ..plans.quantiles import first_rows
from ..plans.spread import spread
from .select import require


def flatten(df: DataFrame) -> DataFrame:
    """Each struct leaf becomes a column named by its path; lists and maps stay."""

    def leaves(prefix: str, value: Column, kind: T.DataType):
        if isinstance(kind, T.StructType) and kind.fields:
            for f in kind.fields:
                yield from leaves(f"{prefix}.{f.name}", value.getField(f.name), f.dataType)
        else:
            yield value.alias(prefix)

    return df.select(*[c for f in df.schema for c in leaves(f.name, F.col(f"`{f.name}`"), f.dataType)])


def packed_keys(df: DataFrame, column: str, position: Column | None = None, max_keys: int | None = None) -> list[str]:
    """Keys found in a packed column over all rows, in order of first use.

    The keys are counted with a partial aggregation, so only one row per key leaves a task.
    All keys are found; with ``max_keys``, more of them are an error, not a cut.
    """
    place = position if position is not None else F.lit(0).cast("long")
    tokens = F.posexplode(F.array_distinct(keys_of(F.col("packed")))).alias("slot", "key")
    keys = (
        spread(df.select(place.alias("place"), F.col(f"`{column}`").alias("packed")))
        .select("place", tokens)
        .groupBy("key")
        .agg(F.min(F.struct("place", "slot")).alias("first"))
        .orderBy("first", "key")
    )
    if max_keys is not None:
        keys = keys.limit(max_keys + 1)
    found = [r["key"] for r in keys.collect()]
    if max_keys is not None and len(found) > max_keys:
        raise ValueError(f"{column!r} holds more than {max_keys} keys; give keys= or a higher max_keys")
    return found


def expand(
    df: DataFrame,
    column: str,
    keys: list[str] | None = None,
    header: list[str] | None = None,
    position: Column | None = None,
    max_keys: int | None = None,
) -> DataFrame:
    """Append a column per key of a packed column; the packed column stays.

    With ``header`` the keys and types are those the ``##INFO`` lines declare (a flag is true
    or false; Integer and Float are numbers only with one value per record). Otherwise the keys
    are ``keys`` or those found, as text. A name in use gets ``_<column>`` appended.
    """
    require(df, column)
    declared = declared_fields(header or [], "INFO")
    if keys is None and declared:
        keys = list(declared)
    if keys is None:
        cell = F.col(f"`{column}`")
        like, full = df.agg(F.count(F.when(looks_packed(cell), 1)), F.count(cell)).first()
        if 2 * like < full or full == 0:
            raise ValueError(f"{column!r} does not hold key=value lists")
        keys = packed_keys(df, column, position, max_keys)
    pairs = "_pairs"
    out, taken = [], set(df.columns)
    for key in keys:
        kind, number = declared.get(key, ("String", ""))
        text = F.try_element_at(F.col(pairs), F.lit(key))
        if kind == "Flag":
            value = F.coalesce(F.array_contains(F.map_keys(pairs), key), F.lit(False))
        elif number in ("1", "") and kind == "Integer":
            value = text.try_cast("long")
        elif number in ("1", "") and kind == "Float":
            value = text.try_cast("double")
        else:
            value = text
        name = key if key not in taken else f"{key}_{column}"
        taken.add(name)
        out.append(value.alias(name))
    unpacked = df.withColumn(pairs, key_values(F.col(f"`{column}`")))
    return unpacked.select(*[F.col(f"`{c}`") for c in df.columns], *out)


_TAG = r"^([A-Za-z][A-Za-z0-9]):([A-Za-z]):(.*)$"


def tags(df: DataFrame, fields: str, names: list[str]) -> DataFrame:
    """Append a column per optional ``TG:type:value`` field held in the array ``fields``.

    The type code decides the column type over all rows: i is a long, f a double, any other
    text; a tag that appears with both i and f is a double, with any text code text. Null
    where a record lacks the tag.
    """
    require(df, fields)
    for name in names:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", name):
            raise ValueError(f"{name!r} is not a two-character tag")
    cell = F.col(f"`{fields}`")
    tag = lambda n: F.get(F.filter(cell, lambda x: x.startswith(f"{n}:")), F.lit(0))
    codes = df.agg(
        *[F.collect_set(F.regexp_extract(tag(n), _TAG, 2)).alias(n) for n in names]
    ).first()  # at most one entry per type letter
    out = []
    for n in names:
        text = F.regexp_extract(tag(n), _TAG, 3)
        used = set(codes[n]) - {""}
        if used and used <= set("cCsSiI"):
            value = text.try_cast("long")
        elif used and used <= set("cCsSiIf"):
            value = text.try_cast("double")
        else:
            value = text
        out.append(value.alias(n if n not in df.columns else f"{n}_tag"))
    return df.select("*", *out)


def matrix_long(df: DataFrame, row: str, columns: list[str] | None = None) -> DataFrame:
    """A wide matrix as (row label, column label, value) of its non-zero cells."""
    columns = columns or [c for c in df.columns if c != row]
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    )
    return df.select(F.col(f"`{row}`").alias("row"), F.inline(cells)).where("value <> 0")


def edge_list(edges: DataFrame, names: DataFrame, i: str, j: str, weight: str) -> DataFrame:
    """Sparse graph entries with the names of both ends: i, j, name_i, name_j, weight.

    ``names`` has columns ``index`` (0-based) and ``name``; an index outside it gives null.
    """
    base = edges.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(weight).alias("weight"))
    for side in ("i", "j"):
        ends = names.select(F.col("index").alias(side), F.col("name").alias(f"name_{side}"))
        base = lookup_join(base, ends, [side])
    return base.select("i", "j", "name_i", "name_j", "weight")


def _fields(df: DataFrame) -> Column:
    """All cells of a record as (place, field, text)."""
    cells = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("field"), text_of(df, c).alias("text")) for i, c in enumerate(df.columns)]
    return F.array(*cells)


def transposed_long(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` records turned, in long form: (place, field, record, text), for any ``n``.

    Records are numbered from 0 in the order of keys that are neither null nor NaN and single out a record.
    They are taken by counting and numbered by a range sort (see :func:`first_rows`), so no task holds them all.
    """
    keys = [k if isinstance(k, Column) else F.col(k) for k in order]
    head = first_rows(df.select(_fields(df).alias("_cells"), *[k.alias(f"_key{i}") for i, k in enumerate(keys)]), [F.col(f"_key{i}") for i in range(len(keys))], n)
    placed = numbered_by(head, [f"_key{i}" for i in range(len(keys))], "record")
    return placed.select("record", F.inline("_cells")).select("place", "field", "record", "text")


def transposed_head(df: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """The first ``n`` records turned: a row per field, a column per record.

    The result has ``n`` columns, which is what bounds a view to read; beyond some thousands
    :func:`transposed_long` has the same cells as rows.
    """
    long = transposed_long(df, n, order)
    turned = long.groupBy("place", "field").pivot("record", list(range(n))).agg(F.first("text"))
    return turned.orderBy("place").drop("place")
