"""Row filters with typed comparisons.

A filter is a Spark ``Column``. :func:`where` builds one atom typed against its column;
atoms combine with ``&`` and ``|`` or :func:`all_of` / :func:`any_of`. A null cell passes none but
``is null`` (its atom is null, which a filter drops), and a NaN cell is only ever ``!=``. The
comparisons stay plain, so that the scan can skip row groups by them.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import FLOATS, column_type, is_number, text_of
from ..plans.joins import member_join
from .select import require

# SAM flag bits by name.
SAM_FLAGS = {
    "PAIRED": 0x1,
    "PROPER_PAIR": 0x2,
    "UNMAP": 0x4,
    "MUNMAP": 0x8,
    "REVERSE": 0x10,
    "MREVERSE": 0x20,
    "READ1": 0x40,
    "READ2": 0x80,
    "SECONDARY": 0x100,
    "QCFAIL": 0x200,
    "DUP": 0x400,
    "SUPPLEMENTARY": 0x800,
}

_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
_TIME = re.compile(r"(\d{4}-\d\d-\d\d)(?:[ T](\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?)\s*(Z|[+-]\d\d:?\d\d)?)?")


def _number(value) -> int | float:
    if isinstance(value, bool):
        raise ValueError("true / false compares with a boolean column only")
    if isinstance(value, (int, float)):
        return value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            raise ValueError(f"{value!r} is not a number") from None


def _moment(value) -> datetime:
    """A date or time literal in UTC without a zone."""
    if isinstance(value, datetime):
        moment = value
    elif isinstance(value, date):
        moment = datetime(value.year, value.month, value.day)
    else:
        parts = _TIME.fullmatch(str(value).strip())
        if not parts:
            raise ValueError(f"{value!r} is not a date or time")
        moment = datetime.fromisoformat(f"{parts[1]} {parts[2] or '00:00'}")
        if parts[3]:
            zone = "+00:00" if parts[3] == "Z" else parts[3]
            moment = moment.replace(tzinfo=datetime.strptime(zone, "%z").tzinfo)
    if moment.tzinfo is not None:
        moment = moment.astimezone(timezone.utc).replace(tzinfo=None)
    return moment


def _literal(kind: T.DataType, value) -> Column:
    """The literal in the kind of its column; the session time zone plays no part."""
    if isinstance(kind, T.FloatType):
        return F.lit(float(_number(value))).cast("float")
    if is_number(kind):
        return F.lit(_number(value))
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise ValueError("a boolean column compares with true or false")
        return F.lit(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.TimestampType):
        return F.lit(_moment(value).isoformat(sep=" ") + "+00:00").cast("timestamp")
    if isinstance(kind, T.DateType):
        moment = _moment(value)
        if moment.time() == datetime.min.time():
            return F.lit(moment.date())
        return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    raise ValueError(f"a {kind.simpleString()} column does not compare with a literal")


def flag_mask(value) -> int:
    """Bits of a flag list: a number (0x904), or names (UNMAP,DUP)."""
    if isinstance(value, int):
        return value
    mask = 0
    for word in str(value).split(","):
        word = word.strip()
        if word.upper() in SAM_FLAGS:
            mask |= SAM_FLAGS[word.upper()]
        else:
            try:
                mask |= int(word, 0)
            except ValueError:
                raise ValueError(f"unknown flag {word!r}; known: {', '.join(SAM_FLAGS)}") from None
    return mask


def where(df: DataFrame, column: str, op: str, value=None) -> Column:
    """One typed atom.

    ``op``: ``== != < <= > >=``, ``~ !~`` (unanchored regular expression), ``contains``,
    ``startswith``, ``endswith``, ``in``, ``not in``, ``is null``, ``is not null``, ``has``,
    ``lacks``. A text column equals a bare number as the text written, but is ordered only
    against text; a number column reads quoted numbers.
    """
    require(df, column)
    kind, cell = column_type(df, column), F.col(f"`{column}`")
    textual = isinstance(kind, T.StringType)
    if op == "is null":
        return cell.isNull()
    if op == "is not null":
        return cell.isNotNull()
    if op in ("has", "lacks"):
        if not is_number(kind) or isinstance(kind, FLOATS + (T.DecimalType,)):
            raise ValueError(f"{op} needs a whole-number column")
        mask = flag_mask(value)
        bits = cell.cast("long").bitwiseAND(F.lit(mask))
        return bits == F.lit(mask if op == "has" else 0)
    if op in ("~", "!~"):
        if (wrong := _pattern_fault(value)) is not None:
            raise ValueError(f"bad regular expression {value!r}: {wrong}")
        if not textual:
            return F.lit(False)
        return cell.rlike(value) if op == "~" else ~cell.rlike(value)
    if op in ("contains", "startswith", "endswith"):
        return getattr(cell, op)(str(value)) if textual else F.lit(False)
    if op in ("in", "not in"):
        members = [_literal(kind, v) for v in value]
        found = cell.isin(members)
        if op == "not in":
            return ~found
        return found & ~F.isnan(cell) if isinstance(kind, FLOATS) else found
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    if textual and op not in ("==", "!=") and not isinstance(value, str):
        raise ValueError(f"{column!r} is text; {op} needs a quoted value")
    if isinstance(kind, T.BooleanType) and op not in ("==", "!="):
        raise ValueError(f"{column!r} is boolean; only == and != apply")
    compared = _COMPARE[op](cell, _literal(kind, value))
    if isinstance(kind, FLOATS) and op != "!=":
        compared = compared & ~F.isnan(cell)
    return compared


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def keep_rows(df: DataFrame, *atoms) -> DataFrame:
    """Rows for which all atoms hold: ``(column, op, value)`` tuples or boolean Columns."""
    built = [a if isinstance(a, Column) else where(df, *a) for a in atoms]
    return df.where(all_of(*built)) if built else df


def narrow(df: DataFrame, column: str, values: list, keep: bool = True) -> Column:
    """Keep or leave out rows by chosen values of a column; None among them means null."""
    chosen = [v for v in values if v is not None]
    nulls = len(chosen) != len(values)
    if keep:
        parts = ([where(df, column, "in", chosen)] if chosen else []) + (
            [where(df, column, "is null")] if nulls else []
        )
        return any_of(*parts)
    parts = ([where(df, column, "not in", chosen)] if chosen else []) + (
        [where(df, column, "is not null")] if nulls else []
    )
    return all_of(*parts)


def members_of(df: DataFrame, column: str, members: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose cell is (not) among the first column of ``members``; null cells in neither."""
    listed = members.select(F.col(f"`{members.columns[0]}`").cast(column_type(df, column)).alias(column))
    return member_join(df, listed.where(F.col(column).isNotNull()), [column], keep)


def member_file(spark, path: str) -> DataFrame:
    """Members of a list file: the first tab field of each line that is not blank."""
    first = F.split("value", "\t")[0]
    return spark.read.text(path).where(F.trim("value") != "").select(first.alias("member"))


def _pattern_fault(pattern: str) -> str | None:
    """What Java's pattern class, which runs the pattern, has against it."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as wrong:
        return str(wrong).splitlines()[0]
    return None


def search(df: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with a match in any column, case-insensitive, with the matching column names.

    The pattern is a regular expression, or plain text when it is not a valid one.
    """
    if _pattern_fault(pattern) is not None:
        pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    names = columns or df.columns
    hits = F.array_compact(
        F.array(*[F.when(text_of(df, c).rlike(f"(?i){pattern}"), F.lit(c)) for c in names])
    )
    return df.withColumn("matched", hits).where(F.size("matched") > 0)


def rows_at(df: DataFrame, position: str, positions: list[int]) -> DataFrame:
    """Rows at the given positions of a position column."""
    return df.where(F.col(position).isin([int(p) for p in positions]))
