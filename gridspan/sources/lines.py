"""Splitting of text lines into fields, with the rules text tables share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unquoted cells that read as null.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# Words for separators.
SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";", "pipe": "|", "space": " "}


def separator(name: str) -> str:
    sep = SEPARATORS.get(name.lower(), name)
    if len(sep) != 1:
        raise ValueError(f"a separator is one character or one of {', '.join(SEPARATORS)}")
    return sep


def _escaped(sep: str) -> str:
    return "\\t" if sep == "\t" else "\\" + sep if not sep.isalnum() and sep != " " else sep


def quoted_fields(line: Column, sep: str) -> Column:
    """Raw fields of a line, quotes kept; a separator inside quotes is part of its field.

    A separator is put in front, so every field is found by the one that comes before it.
    """
    e = _escaped(sep)
    field = rf'{e}("[^"]*+(?:""[^"]*+)*+"[^{e}]*|[^{e}]*)'
    return F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(field), F.lit(1))


def plain_fields(line: Column, sep: str = "\t", limit: int = -1) -> Column:
    return F.split(line, _escaped(sep), limit)


def cell(raw: Column, nulls: tuple[str, ...] = NULL_TOKENS) -> Column:
    """A field's value: a null token is null only without quotes; quotes are taken off."""
    quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) >= 2)
    inner = F.replace(F.substring(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted, inner).when(~raw.isin(*nulls), raw)


def without_return(line: Column) -> Column:
    """The line without the carriage return of a CRLF ending."""
    return F.regexp_replace(line, "\r$", "")


def typed(raw: Column, kind: str) -> Column:
    return raw if kind == "string" else raw.try_cast(kind)


def fields_frame(
    lines: DataFrame, columns: list[tuple[str, str]], nulls: tuple[str, ...] = ("", "."), rest: str | None = None
) -> DataFrame:
    """Tab-separated lines as typed columns; cells of ``nulls`` in columns that are not text are
    null. ``rest`` names an array column for the fields after the last one."""
    parts = plain_fields(without_return(F.col("line")))
    split = lines.withColumn("_f", parts)
    out = []
    for i, (name, kind) in enumerate(columns):
        raw = F.get("_f", F.lit(i))
        out.append((raw if kind == "string" else F.when(~raw.isin(*nulls), raw).try_cast(kind)).alias(name))
    if rest:
        n = len(columns)
        out.append(F.slice("_f", n + 1, F.greatest(F.size("_f") - n, F.lit(0))).alias(rest))
    keep = [c for c in lines.columns if c != "line"]
    return split.select(*keep, *out)
