"""Exact order statistics of columns that do not fit one task.

A value is mapped to one or several longs that sort as the values do: whole numbers, dates and times are
themselves, a double is its sign, exponent and fraction, a wide decimal is cut into groups of digits and a
text into groups of seven bytes. A rank is then found from the highest bits down: one scan counts, for all
columns and ranks together, the values in each bucket of equal leading bits, and only the bucket that holds
the rank is cut further, below the bits that its least and greatest value have in common. A bucket of few
values is counted value by value. Each scan is one partial aggregation, with at most ``SMALL`` rows per
bracket after it, and takes twelve bits at least; nothing but the buckets found reaches the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arith import epoch_micros

# Values of a bracket that are counted one by one.
SMALL = 65_536
# Rows of a top-k, which every task holds; more are found by the value they are cut at.
TOP = 1_000
_BITS = 12
_SIGN = -(1 << 63)
_GROUP = 10**13


@dataclass(frozen=True)
class Keys:
    """The longs of a column: ``level(i)`` is the i-th, ``value`` turns a full list back (None: not yet full)."""

    level: Callable[[int], Column]
    value: Callable[[list[int]], object]
    made: dict[int, Column] = field(default_factory=dict, compare=False)

    def column(self, i: int) -> Column:
        """The i-th long, made once."""
        if i not in self.made:
            self.made[i] = self.level(i)
        return self.made[i]


def _long(x: int) -> str:
    return f"bigint('{x}')"


def _double_bits(x: Column) -> Column:
    """The IEEE bits of a double as a long that sorts like it, by exact arithmetic."""
    size = F.abs(x)
    exponent = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    fraction = size / F.pow(F.lit(2.0), exponent)
    # normal numbers hold the leading one of their fraction, which adds 1 to the exponent's field
    joined = lambda up, scale: (exponent + (1022 + up)) * F.lit(1 << 52) + (fraction * F.lit(scale)).cast("long")
    # the logarithm may miss by one beside a power of two
    bits = (
        F.when(size == float("inf"), F.lit(2047 << 52))
        .when(size == 0, F.lit(0))
        .when(fraction >= 2, joined(1, 2.0**51))
        .when((fraction < 1) & (exponent > -1022), joined(-1, 2.0**53))
        .otherwise(joined(0, 2.0**52))
    )
    return F.when(x < 0, -bits).otherwise(bits)


def _double_of(keys: list[int]) -> float:
    return struct.unpack("<d", struct.pack("<q", abs(keys[0])))[0] * (-1 if keys[0] < 0 else 1)


def _text_group(bytes_: Column, i: int) -> Column:
    """Seven bytes from place 7 i and how many there are: shorter texts come before their continuations."""
    part = F.substring(bytes_, 7 * i + 1, 7)
    number = F.conv(F.rpad(F.hex(part), 14, "0"), 16, 10).cast("long")
    return F.when(F.octet_length(part) == 0, F.lit(0)).otherwise(number * 8 + F.octet_length(part))


def _text_of(keys: list[int]) -> bytes | None:
    if keys and keys[-1] % 8 == 7:
        return None
    return b"".join((k >> 3).to_bytes(7, "big")[: k % 8] for k in keys)


def keys_of(cell: Column, kind: T.DataType) -> Keys:
    """The longs that sort like the values of ``cell``; NaN, like null, has none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = cell.cast("double")
        return Keys(lambda _: F.when(~F.isnan(x), _double_bits(x)), lambda k: _double_of(k) if k else None)
    if isinstance(kind, T.DecimalType) and kind.precision > 18:
        # all digits at fixed places: arithmetic on so many would round
        pattern = "S" + "0" * max(1, kind.precision - kind.scale) + ("." + "0" * kind.scale if kind.scale else "")
        text = F.to_char(cell, F.lit(pattern))
        digits, sign = F.lpad(F.translate(text, "+-.", ""), 39, "0"), F.when(text.startswith("-"), -1).otherwise(1)
        parts = [F.substring(digits, 13 * i + 1, 13).cast("long") * sign for i in range(3)]
        back = lambda k: Decimal((k[0] * _GROUP + k[1]) * _GROUP + k[2]).scaleb(-kind.scale) if len(k) == 3 else None
        return Keys(lambda i: parts[i], back)
    if isinstance(kind, T.DecimalType):
        whole = (cell * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("long")
        return Keys(lambda _: whole, lambda k: Decimal(k[0]).scaleb(-kind.scale) if k else None)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = cell.cast("binary")
        text = isinstance(kind, T.StringType)
        return Keys(lambda i: _text_group(data, i), lambda k: None if (b := _text_of(k)) is None or not k else b.decode() if text else b)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        cell = epoch_micros(cell, kind)
    return Keys(lambda _: cell.cast("long"), lambda k: k[0] if k else None)


@dataclass(frozen=True)
class _Place:
    """The value at ``rank`` of ``column`` among those whose first longs are ``path`` and whose next one lies in
    [low, high]; ``rank`` counts from the least of these, of which there are ``inside``."""

    column: str
    wanted: int
    rank: int
    path: tuple[int, ...] = ()
    low: int = _SIGN
    high: int = -_SIGN - 1
    inside: int = -1
    below: int = field(default=0, compare=False)

    @property
    def bracket(self) -> tuple:
        return self.column, self.path, self.low, self.high, self.inside

    def bits(self) -> int:
        """How many low bits differ in the bracket."""
        return ((self.low ^ self.high) & ((1 << 64) - 1)).bit_length()


def _ends(df: DataFrame, keys: dict[str, Keys], places: list[_Place]) -> list[_Place]:
    """The places in the brackets of their whole columns: one scan with plain aggregates."""
    columns = list(dict.fromkeys(p.column for p in places))
    parts = [f(keys[c].column(0)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("n", F.count), ("low", F.min), ("high", F.max))]
    row = df.agg(*parts).first()
    at = {c: i for i, c in enumerate(columns)}
    ends = {c: {"inside": row[f"n{i}"], "low": row[f"low{i}"], "high": row[f"high{i}"]} for c, i in at.items()}
    return [replace(p, **ends[p.column]) for p in places if p.rank < ends[p.column]["inside"]]


def _turn(df: DataFrame, keys: dict[str, Keys], places: list[_Place], small: int) -> list[_Place]:
    """All places one step further: one job for all columns and ranks, which reads each column once."""
    brackets = list(dict.fromkeys(p.bracket for p in places))
    number = {b: i for i, b in enumerate(brackets)}
    first = {p.bracket: p for p in reversed(places)}
    parts = []
    for column in dict.fromkeys(b[0] for b in brackets):
        # a column by itself: its branch of the job reads nothing else, and its code is short enough to be compiled
        mine = [b for b in brackets if b[0] == column]
        made = [keys[column].column(i).alias(f"k{i}") for i in range(max(len(b[1]) for b in mine) + 1)]
        # a generator of one row: what is asked of a long below does not make it again
        base = df.select(F.inline(F.array(F.struct(*made))))
        cases = []
        for b in mine:
            _, path, low, high, inside = b
            key, bits = f"k{len(path)}", first[b].bits()
            tests = [f"k{i} = {_long(k)}" for i, k in enumerate(path)]
            tests.append(f"{key} IS NOT NULL" if inside < 0 else f"{key} BETWEEN {_long(low)} AND {_long(high)}")
            if inside < 0:
                bucket = "0L"
            elif inside <= small or bits <= _BITS:
                bucket = key
            else:
                bucket = f"shiftrightunsigned({key}, {bits - _BITS}) & {(1 << _BITS) - 1}L"
                if bits == 64:
                    bucket = f"({bucket}) ^ {1 << (_BITS - 1)}L"
            cases.append((" AND ".join(tests), number[b], bucket, key))
        pick = lambda i: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[i]}" for c in cases) + " END"
        parts.append(base.selectExpr(f"{pick(1)} AS slot", f"{pick(2)} AS bucket", f"{pick(3)} AS value").where("slot IS NOT NULL"))
    counted = reduce(DataFrame.unionAll, parts)
    counted = counted.groupBy("slot", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    # at most 2**_BITS or ``small`` rows of a bracket
    counted = counted.selectExpr("*", "sum(n) OVER (PARTITION BY slot ORDER BY bucket) AS through")
    hits = sorted({f"(slot = {number[p.bracket]} AND through > {p.rank}L AND through - n <= {p.rank}L)" for p in places})
    found = counted.where(" OR ".join(hits)).collect()
    out = []
    for p in places:
        for row in found:
            before = row["through"] - row["n"]
            if row["slot"] == number[p.bracket] and before <= p.rank < row["through"]:
                out.append(replace(p, rank=p.rank - before, below=p.below + before, low=row["low"], high=row["high"], inside=row["n"]))
    return out


def select_ranks(df: DataFrame, keys: dict[str, Keys], ranks: dict[str, list[int]], small: int = SMALL) -> dict:
    """``{(column, rank): (value, longs, values below)}``; ranks past a column's values are left out."""
    places = _ends(df, keys, [_Place(c, r, r) for c, asked in ranks.items() for r in sorted(set(asked))])
    found: dict = {}
    first = True
    while places:
        going = []
        # a column of one value needs no turn
        for p in places if first else _turn(df, keys, places, small):
            while p is not None and p.low == p.high:
                path = (*p.path, p.low)
                value = keys[p.column].value(list(path))
                if value is not None:
                    found[(p.column, p.wanted)] = (value, path, p.below)
                    p = None
                else:
                    p = replace(p, path=path, low=_SIGN, high=-_SIGN - 1, inside=-1)
            if p is not None:
                going.append(p)
        places, first = going, False
    return found


def exact_ranks(df: DataFrame, ranks: dict[str, list[int]], small: int = SMALL) -> dict:
    """``{(column, rank): value}`` for 0-based ranks among the non-null, non-NaN values of each column."""
    kinds = {f.name: f.dataType for f in df.schema}
    keys = {c: keys_of(F.col(f"`{c}`"), kinds[c]) for c in ranks}
    return {place: value for place, (value, _, _) in select_ranks(df, keys, ranks, small).items()}


def exact_percentiles(df: DataFrame, columns: list[str], shares: list[float], counts: dict[str, int], small: int = SMALL) -> dict:
    """``{(column, share): value}``, interpolated linearly between the two nearest ranks.

    ``counts`` are the non-null, non-NaN values per column. Doubles are interpolated as doubles; whole numbers,
    decimals and times (as microseconds since 1970) exactly, as fractions.
    """
    ends = {}
    for column in columns:
        for share in shares:
            if counts[column]:
                place = Fraction(share).limit_denominator(10**9) * (counts[column] - 1)
                low = place.numerator // place.denominator
                ends[(column, share)] = (low, min(low + 1, counts[column] - 1), place - low)
    ranks: dict[str, list[int]] = {}
    for (column, _), (low, high, _) in ends.items():
        ranks.setdefault(column, []).extend([low, high])
    values = exact_ranks(df, ranks, small) if ranks else {}
    result = {}
    for (column, share), (low, high, part) in ends.items():
        a, b = values[(column, low)], values[(column, high)]
        if isinstance(a, float):
            result[(column, share)] = a + float(part) * (b - a) if b != a else a
        else:
            result[(column, share)] = Fraction(a) + part * (Fraction(b) - Fraction(a))
    return result


def first_rows(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """The ``n`` smallest rows under ``keys``, which are not null and not NaN.

    Up to ``TOP`` rows are a top-k, which never sorts the table. For more, the row they are cut at is found by
    counting, and the rows before it are taken by a filter, so no task holds all ``n``; only rows that are
    equal to it in all keys are limited.
    """
    if n <= TOP:
        return df.orderBy(*keys).limit(n)
    kinds = df.select(*[k.alias(f"k{i}") if isinstance(k, Column) else F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).schema
    cells = [k if isinstance(k, Column) else F.col(k) for k in keys]
    parts = [keys_of(c, f.dataType) for c, f in zip(cells, kinds)]
    levels: list[tuple[int, int]] = []

    def level(i: int) -> Column:
        key, at = levels[i]
        return parts[key].level(at)

    def full(path: list[int]) -> bool | None:
        """Which key's longs come next follows from those found."""
        levels[:] = []
        key, first = 0, 0
        for i in range(len(path) + 1):
            levels.append((key, i - first))
            if i < len(path) and parts[key].value(path[first : i + 1]) is not None:
                key, first = key + 1, i + 1
                if key == len(parts):
                    return True
        return None

    full([])
    found = select_ranks(df, {"row": Keys(level, full)}, {"row": [n - 1]})
    if not found:
        return df
    _, path, below = found[("row", n - 1)]
    full(list(path))
    before, equal = F.lit(False), F.lit(True)
    for i, k in enumerate(path):
        before = before | (equal & (level(i) < k))
        equal = equal & (level(i) == k)
    return df.where(before).unionByName(df.where(equal).limit(n - below))
