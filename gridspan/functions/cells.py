"""Cell text and type classes.

Two cells are the same when their text is the same; reports and comparisons share the one
rendering below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the text form.
NULL_CELL = "∅"
NAN_TEXT, INF_TEXT, NEG_INF_TEXT = "nan", "inf", "-inf"

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, INTEGERS + FLOATS + (T.DecimalType,))


def type_class(kind: T.DataType) -> str:
    """numeric, string, list, bool, temporal or other: the classes a column spec can name."""
    if is_number(kind):
        return "numeric"
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return "string"
    if isinstance(kind, T.ArrayType):
        return "list"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, TEMPORAL):
        return "temporal"
    return "other"


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def float_text(value: Column) -> Column:
    """Shortest digits that read back as the same number; whole numbers without a point.

    The common cases come first, each with a single conversion.
    """
    shown, size = value.cast("string"), F.abs(value)
    point = F.rtrim(value.cast("decimal(38,17)").cast("string"), F.lit("0"))
    scientific = F.regexp_replace(F.regexp_replace(shown, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2")
    scientific = F.regexp_replace(F.regexp_replace(scientific, r"E(\d)", "e+$1"), "E-", "e-")
    return (
        F.when((value == F.floor(value)) & (size < 1e15) & (value != 0), value.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), shown)
        .when(value == 0, F.when(shown.startswith("-"), "-0").otherwise("0"))
        .when((size >= 1e-3) & (size < 1e15), point)
        .when(F.isnan(value), NAN_TEXT)
        .when(size == float("inf"), F.when(value > 0, INF_TEXT).otherwise(NEG_INF_TEXT))
        .otherwise(scientific)
    )


def cell_text(value: Column, kind: T.DataType) -> Column:
    """The text of a cell, null for null; inside lists and maps a null shows as a symbol."""
    if isinstance(kind, FLOATS):
        return float_text(value)
    if isinstance(kind, T.BinaryType):
        text = F.try_validate_utf8(value.cast("string"))
        printable = text.isNotNull() & ~text.rlike("[\\x00-\\x1f\\x7f]")
        return F.when(printable, text).otherwise(F.concat(F.lit("0x"), F.lower(F.hex(value))))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zone = "'Z'" if isinstance(kind, T.TimestampType) else ""
        return F.date_format(value, f"yyyy-MM-dd HH:mm:ss.SSSSSS{zone}")
    if isinstance(kind, T.ArrayType):
        parts = F.transform(value, lambda x: _inner(x, kind.elementType))
        return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))
    if isinstance(kind, T.MapType):
        parts = F.transform(
            F.map_entries(value),
            lambda e: F.concat(_inner(e["key"], kind.keyType), F.lit(": "), _inner(e["value"], kind.valueType)),
        )
        return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
    if isinstance(kind, T.StructType):
        parts = F.array_compact(
            F.array(
                *[
                    F.concat(F.lit(f"{f.name}: "), cell_text(value.getField(f.name), f.dataType))
                    for f in kind.fields
                ]
            )
        )
        shown = F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))
        return F.when(value.isNotNull(), shown)
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")


def _inner(value: Column, kind: T.DataType) -> Column:
    return F.coalesce(cell_text(value, kind), F.lit(NULL_CELL))


def text_of(df: DataFrame, name: str) -> Column:
    return cell_text(F.col(f"`{name}`"), column_type(df, name))


def grouped_digits(value: Column) -> Column:
    """1234567 as 1_234_567, for text reports."""
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit("_"))


def sparkline(counts: Column) -> Column:
    """One block character per bin, scaled to the fullest bin; an empty bin is a space."""
    # The block characters from lowest to fullest.
    blocks = "▁▂▃▄▅▆▇█"
    top = F.array_max(counts)
    level = lambda n: F.ceil(n * len(blocks) / top).cast("int")
    glyph = lambda n: F.when(n > 0, F.substring(F.lit(blocks), level(n), F.lit(1))).otherwise(" ")
    return F.array_join(F.transform(counts, glyph), "")
