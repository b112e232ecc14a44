"""Arithmetic that gives null instead of failing.

Whole-number operands stay 64-bit and overflow to null; division and logarithms are always
double; a division by zero, the log of a number not above zero and any non-finite result
are null; a null operand gives null. Date, time and boolean operands act as their stored
numbers. Each function takes a frame only through column types, so operands are wrapped
with :func:`operand` first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cells import FLOATS, INTEGERS, column_type

_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Number:
    """A numeric expression and whether it is a whole number; supports + - * / and unary -."""

    value: Column
    whole: bool
    # how often a column stands in a whole-number expression
    weight: int = 1

    def __add__(self, other):
        return _pair(self, other, _added)

    def __radd__(self, other):
        return as_number(other) + self

    def __sub__(self, other):
        return _pair(self, other, _subtracted)

    def __rsub__(self, other):
        return as_number(other) - self

    def __mul__(self, other):
        return _pair(self, other, _multiplied)

    def __rmul__(self, other):
        return as_number(other) * self

    def __truediv__(self, other):
        other = as_number(other)
        return Number(_finite(F.try_divide(_double(self), _double(other))), False)

    def __rtruediv__(self, other):
        return as_number(other) / self

    def __neg__(self):
        if self.whole:
            return as_number(0) - self
        return Number(-self.value, False)


def _double(n: Number) -> Column:
    return n.value.cast("double")


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


# The try functions throw and catch an exception for every row that overflows, some 30 microseconds each. Rows that
# surely overflow are told before; the bounds themselves cannot overflow.


def _added(a: Column, b: Column) -> Column:
    none = F.lit(0).cast("long")
    beyond = (a > F.lit(_HIGHEST) - F.greatest(b, none)) | (a < F.lit(_LOWEST) - F.least(b, none))
    return F.when(~F.coalesce(beyond, F.lit(False)), F.try_add(a, b))


def _subtracted(a: Column, b: Column) -> Column:
    none = F.lit(0).cast("long")
    beyond = (a < F.lit(_LOWEST) + F.greatest(b, none)) | (a > F.lit(_HIGHEST) + F.least(b, none))
    return F.when(~F.coalesce(beyond, F.lit(False)), F.try_subtract(a, b))


def _multiplied(a: Column, b: Column) -> Column:
    """A product of doubles is off by less than 2**-50 of itself; only those that close to 2**63 are left to try."""
    beyond = F.abs(a.cast("double") * b.cast("double")) > float((1 << 63) + (1 << 13))
    return F.when(~F.coalesce(beyond, F.lit(False)), F.try_multiply(a, b))


_INLINE = 100
_DOUBLES = {_added: F.try_add, _subtracted: F.try_subtract, _multiplied: F.try_multiply}


def _pair(a: Number, b, op) -> Number:
    b = as_number(b)
    if a.whole and b.whole:
        weight = a.weight + b.weight
        if weight <= _INLINE:
            return Number(op(a.value, b.value), True, 3 * weight)
        # operands are named once, so that a long chain does not repeat them at each of its steps
        bound = F.transform(F.array(F.struct(a.value.alias("a"), b.value.alias("b"))), lambda x: op(x["a"], x["b"]))
        return Number(F.get(bound, F.lit(0)), True, weight)
    return Number(_finite(_DOUBLES[op](_double(a), _double(b))), False)


def as_number(value) -> Number:
    if isinstance(value, Number):
        return value
    if isinstance(value, bool):
        return Number(F.lit(int(value)).cast("long"), True)
    if isinstance(value, int):
        return Number(F.lit(value).cast("long"), True)
    if isinstance(value, float):
        return Number(F.lit(value), False)
    raise TypeError(f"not a number: {value!r}; wrap columns with operand(df, name)")


def epoch_micros(value: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970 of a date or time; one without a zone counts as UTC, whatever the
    time zone of the session."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long") * 86_400_000_000
    if isinstance(kind, T.TimestampNTZType):
        value = F.from_utc_timestamp(value.cast("timestamp"), F.current_timezone())
    return F.unix_micros(value)


def operand(df: DataFrame, name: str) -> Number:
    """A column as an arithmetic operand; text and nested columns are refused."""
    kind, value = column_type(df, name), F.col(f"`{name}`")
    if isinstance(kind, INTEGERS):
        return Number(value.cast("long"), True)
    if isinstance(kind, FLOATS):
        return Number(_finite(value.cast("double")), False)
    if isinstance(kind, T.DecimalType):
        return Number(value.cast("double"), False)
    if isinstance(kind, T.BooleanType):
        return Number(value.cast("int").cast("long"), True)
    if isinstance(kind, T.DateType):
        return Number(F.unix_date(value).cast("long"), True)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Number(epoch_micros(value, kind), True)
    raise TypeError(f"column {name!r} is {kind.simpleString()}, not a number; length() gives its length")


def length(df: DataFrame, name: str) -> Number:
    """Characters of a text, elements of a list, bytes of a binary cell."""
    kind, value = column_type(df, name), F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return Number(F.char_length(value).cast("long"), True)
    if isinstance(kind, T.BinaryType):
        return Number(F.octet_length(value).cast("long"), True)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return Number(F.when(value.isNotNull(), F.size(value)).cast("long"), True)
    raise TypeError(f"column {name!r} is {kind.simpleString()}, which has no length")


def absolute(n) -> Number:
    n = as_number(n)
    if n.whole:
        return Number(F.abs(F.when(n.value != _LOWEST, n.value)), True, 2 * n.weight)
    return Number(F.abs(n.value), False)


def log10(n) -> Number:
    return Number(_finite(F.log10(_double(as_number(n)))), False)


def log2(n) -> Number:
    return Number(_finite(F.log2(_double(as_number(n)))), False)


def rounded(n, digits: int = 0) -> Number:
    """Round half away from zero, to ``digits`` decimals or, if negative, to tens, hundreds …"""
    n = as_number(n)
    if n.whole:
        if digits >= 0:
            return n
        if digits < -18:
            return Number(F.when(n.value.isNotNull(), F.lit(0)).cast("long"), True)
        step = 10**-digits
        wide = n.value.cast("decimal(20,0)")
        near = F.floor((F.abs(wide) + step // 2) / F.lit(step).cast("decimal(20,0)")) * F.lit(step)
        signed = F.when(n.value < 0, -near).otherwise(near)
        return Number(signed.cast("decimal(38,0)").try_cast("long"), True)
    if abs(digits) > 300:
        return n if digits > 0 else Number(n.value * 0.0, False)
    scale = 10.0 ** abs(digits)
    scaled = n.value * scale if digits >= 0 else n.value / scale
    # beyond 2**52 a double has no fraction left to round, and a long may not hold it
    whole = F.floor(F.abs(scaled) + 0.5).cast("double") * F.signum(scaled)
    near = F.when(F.abs(scaled) < float(1 << 52), whole).otherwise(scaled)
    return Number(_finite(near / scale if digits >= 0 else near * scale), False)


def _extreme(op, values) -> Number:
    numbers = [as_number(v) for v in values]
    whole = all(n.whole for n in numbers)
    columns = [n.value if whole else _double(n) for n in numbers]
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    best = columns[0] if len(columns) == 1 else op(*columns)
    return Number(F.when(present, best), whole)


def smallest(*values) -> Number:
    """Row-wise minimum; null when any argument is null."""
    return _extreme(F.least, values)


def largest(*values) -> Number:
    """Row-wise maximum; null when any argument is null."""
    return _extreme(F.greatest, values)
