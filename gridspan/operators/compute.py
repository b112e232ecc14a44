"""Derived columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..functions.arith import Number, operand


def compute(df: DataFrame, **columns: Column | Callable) -> DataFrame:
    """Append columns in the order given; a later one may use an earlier one.

    A value is a Spark Column, or a function that takes a lookup ``n`` from column name to a
    null-safe :class:`Number`: ``compute(df, kb=lambda n: (n("end") - n("start")) / 1000)``.
    A name already in use is an error.
    """
    for name, value in columns.items():
        if name in df.columns:
            raise ValueError(f"column {name!r} is there already")
        if callable(value) and not isinstance(value, Column):
            frame = df
            value = value(lambda column: operand(frame, column))  # noqa: B023
        df = df.withColumn(name, value.value if isinstance(value, Number) else value)
    return df
