"""Column choice by name, pattern, range or type class."""

from __future__ import annotations

import re
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import type_class

CLASSES = ("numeric", "string", "list", "bool", "temporal")
_RANGE = re.compile(r"(\d+)-(\d*)")


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(name: str, columns: list[str]) -> str | None:
    """The nearest column name, if it is near enough to be a slip."""
    bound = min(3, max(1, len(name) // 4))
    near = min(((_distance(name.lower(), c.lower()), c) for c in columns), default=(bound + 1, ""))
    return near[1] if near[0] <= bound else None


def unknown_column(name: str, columns: list[str]) -> ValueError:
    hint = suggestion(name, columns)
    return ValueError(f"no column {name!r}" + (f"; did you mean {hint!r}?" if hint else ""))


def require(df: DataFrame, *names: str) -> None:
    for name in names:
        if name not in df.columns:
            raise unknown_column(name, df.columns)


def _term(df: DataFrame, term: str) -> list[str]:
    columns = df.columns
    if term in columns:
        return [term]
    if term.startswith("@"):
        if term[1:] not in CLASSES:
            raise ValueError(f"unknown class {term!r}; known: {', '.join('@' + c for c in CLASSES)}")
        found = [f.name for f in df.schema if type_class(f.dataType) == term[1:]]
    elif (span := _RANGE.fullmatch(term)) and not any(_RANGE.fullmatch(c) for c in columns):
        found = columns[max(int(span[1]), 1) - 1 : int(span[2]) if span[2] else None]
    elif any(c in term for c in "*?["):
        found = [c for c in columns if fnmatchcase(c, term)]
    else:
        raise unknown_column(term, columns)
    if not found:
        raise ValueError(f"{term!r} matches no column")
    return found


def resolve_columns(df: DataFrame, spec: str | list[str]) -> list[str]:
    """Column names of a spec: names, ``@class``, ``2-4``, globs and ``!exclusions``.

    The order of the spec is kept and a name appears once. A spec of exclusions alone starts
    from all columns. A term that matches nothing is an error, and so is an empty result.
    """
    terms = [t.strip() for t in spec.split(",")] if isinstance(spec, str) else list(spec)
    terms = [t for t in terms if t]
    banned = lambda t: t.startswith("!") and t not in df.columns
    kept: dict[str, None] = {}
    dropped: set[str] = set()
    if terms and all(banned(t) for t in terms):
        kept = dict.fromkeys(df.columns)
    for term in terms:
        if banned(term):
            dropped.update(_term(df, term[1:]))
        else:
            kept.update(dict.fromkeys(_term(df, term)))
    result = [c for c in kept if c not in dropped]
    if not result:
        raise ValueError(f"{spec!r} leaves no column")
    return result


def select_columns(df: DataFrame, spec: str | list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in resolve_columns(df, spec)])
