"""CSV, TSV and other separated tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import small_side
from ..plans.position import ordered_lines, text_lines
from ..session import settle
from .lines import NULL_TOKENS, cell, quoted_fields, separator, typed, without_return

TYPES = {"string": "string", "int": "long", "float": "double"}
_INT = r"^[+-]?\d+$"
_NUMBER = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|nan|Inf|NaN|INF)$"


@dataclass
class _Shape:
    names: list[str]
    has_header: bool


def _counted(lines: DataFrame, comment: str | None) -> DataFrame:
    """The lines that count: neither blank nor a comment, without the carriage return of their ending."""
    lines = lines.withColumn("line", without_return(F.col("line")))
    if comment:
        lines = lines.where(~F.col("line").startswith(comment))
    return lines.where(F.trim("line") != "")


def _widths(lines: DataFrame, sep: str) -> DataFrame:
    """(file, split, fields, n, id): the lines of each number of fields in a split, and the least id among them.

    One scan; all that is kept of it are numbers.
    """
    sized = lines.select("file", "at.split", "at.id", F.size(quoted_fields(F.col("line"), sep)).alias("fields"))
    return settle(sized.groupBy("file", "split", "fields").agg(F.count("*").alias("n"), F.min("id").alias("id")))


def _first_lines(lines: DataFrame, widths: DataFrame, sep: str, nulls: tuple[str, ...]) -> tuple[DataFrame, Row]:
    """(file, _at, line, _names): place, text and cells of the first line that counts in each file; and the first file's."""
    places = widths.groupBy("file").agg(F.min(F.struct("split", "id")).alias("_at"), F.count("*").alias("_rows"))
    alone = places.limit(2).collect()
    if not alone:
        raise ValueError("the file has no lines")
    if len(alone) == 1:
        # found where it stands, without a look at the rest of the file
        place = alone[0]
        here = (F.col("at.split") == place["_at"]["split"]) & (F.col("at.id") == place["_at"]["id"])
        found = lines.where(here).limit(1).select("file", F.col("at").alias("_at"), "line")
    else:
        found = lines.withColumn("_at", F.col("at")).join(small_side(places.drop("_rows")), ["file", "_at"]).select("file", "_at", "line")
    own = F.transform(quoted_fields(F.col("line"), sep), lambda x: cell(x, nulls)).alias("_names")
    first = small_side(found.select("file", "_at", "line", own))
    return first, first.orderBy("file").first()


def _below(lines: DataFrame, first: DataFrame) -> DataFrame:
    """The lines but the first ones, with the cells of those (``_names``)."""
    return lines.join(first.select("file", "_at", "_names"), "file").where("at.split <> _at.split OR at.id <> _at.id").drop("_at")


def _one_wider(widths: DataFrame, first: DataFrame, width: int) -> bool:
    """Whether more lines below the first ones are one field wider than are as wide."""
    lines = widths.groupBy("fields").agg(F.sum("n").alias("n")).where(F.col("fields").isin(width, width + 1))
    n = {r["fields"]: r["n"] for r in lines.collect()}
    own = {r["fields"]: r["n"] for r in first.groupBy(F.size("_names").alias("fields")).agg(F.count("*").alias("n")).where(F.col("fields").isin(width, width + 1)).collect()}
    return n.get(width + 1, 0) - own.get(width + 1, 0) > n.get(width, 0) - own.get(width, 0)


def _is_number(text: str | None) -> bool:
    return text is not None and re.search(_NUMBER, text) is not None


def _shape(first: list[str | None], short: bool, numeric: list[int], header: str) -> _Shape:
    """Whether the first line is a header, and the column names.

    It is data when it fits the columns below it: some column below is all numbers and the first
    line has a number there too. A header one field short of most rows names a leading ``index``
    column.
    """
    if header == "auto":
        if short:
            found = True
        elif numeric:
            found = not any(_is_number(first[i]) for i in numeric)
        else:
            found = all(x is not None and not _is_number(x) for x in first) and len(set(first)) == len(first)
    else:
        found = header == "on"
    if not found:
        return _Shape([f"f{i}" for i in range(len(first))], False)
    names = [x if x is not None else f"f{i}" for i, x in enumerate(first)]
    if short:
        names = ["index", *names]
    seen: dict[str, int] = {}
    unique = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        unique.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return _Shape(unique, True)


def _given_types(types: dict[str, str] | None, names: list[str]) -> dict[str, str]:
    given = {}
    for column, kind in (types or {}).items():
        if kind not in TYPES:
            raise ValueError(f"type {kind!r} is not one of {', '.join(TYPES)}")
        if column != "*" and column not in names:
            raise ValueError(f"no column {column!r} to type")
    for name in names:
        kind = (types or {}).get(name, (types or {}).get("*"))
        if kind:
            given[name] = TYPES[kind]
    return given


def _by_name(headers: DataFrame, head: list[str | None], fields: Column, width: int) -> Column:
    """The fields of a line in the order of ``head``, whatever the order in the header of its file.

    Files whose headers hold other names than ``head`` are an error. Lines of another width stay as they are.
    """
    wanted = F.array(*[F.lit(n).cast("string") for n in head])
    other = headers.where(F.sort_array("_names") != F.sort_array(wanted)).limit(1).collect()
    if other:
        raise ValueError(f"{other[0]['file']} names columns {other[0]['_names']}, another file {head}")
    if headers.where(F.col("_names") != wanted).isEmpty():
        return fields
    if len(set(head)) < len(head) or None in head:
        raise ValueError(f"files order their columns differently and some names are not unique: {head}")
    lead = width - len(head)
    place = lambda n: (F.array_position("_names", n) + (lead - 1)).cast("int")
    placed = F.transform(wanted, lambda n: F.get(fields, place(n)))
    return F.when(F.size(fields) == width, F.concat(F.slice(fields, 1, lead), placed)).otherwise(fields)


class Delimited:
    """A separated table: ``table`` and ``bad_rows`` (file, line_no from 1, line), which are found when asked for."""

    def __init__(self, table: DataFrame, bad: Callable[[], DataFrame]):
        self.table = table
        self._bad = bad

    @cached_property
    def bad_rows(self) -> DataFrame:
        return self._bad()


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    header: str = "auto",
    types: dict[str, str] | None = None,
    on_bad_row: str = "stop",
    nulls: tuple[str, ...] = NULL_TOKENS,
    comment: str | None = None,
) -> Delimited:
    """Read a separated table with typed columns.

    Two scans come before the read: one counts fields and finds the first lines, one looks at all cells. Types
    come from that aggregation over every row, so a late value widens its column (whole
    number, number, text) instead of failing; a column with leading zeros such as 007 stays
    text; ``types`` overrides by name or ``*``. Whether there is a header, and whether it is one field
    short, is decided on every row as well. A null token is null only where it is not quoted.
    Lines that start with ``comment`` count nowhere. Files with headers are put together by name; files
    that name other columns are an error. A cell holds no line break: a line that opens a quote and does
    not close it is malformed.
    A row with another number of fields stops the read (the error names the first), is skipped, or is padded with nulls and
    cut (``on_bad_row`` = stop / skip / null) and is listed in ``bad_rows``.
    """
    if on_bad_row not in ("stop", "skip", "null") or header not in ("auto", "on", "off"):
        raise ValueError("on_bad_row is stop, skip or null; header is auto, on or off")
    sep = separator(sep)
    lines = _counted(ordered_lines(spark, path), comment)
    widths = _widths(lines, sep)
    first, whole = _first_lines(lines, widths, sep, nulls)
    head = whole["_names"]
    short = header != "off" and _one_wider(widths, first, len(head))
    width = len(head) + short
    raw = quoted_fields(F.col("line"), sep)
    last = F.element_at(raw, -1)
    # a quote that opens a cell and is not closed in its line: a line break inside a cell
    torn = last.startswith('"') & ((F.length(last) - F.length(F.replace(last, F.lit('"'), F.lit("")))) % 2 == 1)
    wrong = (F.size(raw) != width) | torn
    wanted = F.array(*[F.lit(n).cast("string") for n in head])
    alike = header != "off" and first.where(F.sort_array("_names") != F.sort_array(wanted)).isEmpty()
    by_name = header == "on" or (alike and len(set(head)) == len(head) and None not in head)

    def cells(rows: DataFrame, fields: Column) -> DataFrame:
        kept = rows.where(~wrong) if on_bad_row == "skip" else rows
        split = kept.withColumn("_f", fields)
        return split.select(wrong.alias("_wrong"), F.size("_f").alias("_size"), *[cell(F.get("_f", F.lit(i)), nulls).alias(f"c{i}") for i in range(width)])

    def look(rows: DataFrame, fields: Column) -> Row:
        """What the columns hold, and how many rows are wrong, in one pass."""
        values = cells(rows, fields)
        numbers = [F.bool_and(F.when(F.col("_size") == len(head), F.col(f"c{i}").rlike(_NUMBER))).alias(f"number{i}") for i in range(len(head))]
        return values.agg(F.count_if("_wrong").alias("wrong"), *numbers, *_tests(range(width))).first()

    aligned = _by_name(first, head, raw, width) if by_name else raw
    data = lines if header == "off" else _below(lines, first)
    facts = look(data, aligned)
    shape = _shape(head, short, [i for i in range(len(head)) if facts[f"number{i}"]] if header != "off" else [], header)
    names, seen = shape.names, [facts]
    if shape.has_header and not by_name:
        aligned = _by_name(first, head, raw, width)
    if not shape.has_header and header != "off":
        # the first lines are data; where files were put in order by them, that was no order
        data, seen = lines, [facts, look(first, raw)] if not by_name else [look(lines, raw)]
        aligned = raw
    bad = lambda: _bad_rows(spark, path, comment, wrong, shape.has_header)
    if on_bad_row == "stop" and any(row["wrong"] for row in seen):
        p = bad().withColumn("found", F.size(raw)).orderBy("file", "line_no").first()
        raise ValueError(f"{p['file']}: line {p['line_no']}: expected {width} fields, got {p['found']}: {p['line']}")
    given = _given_types(types, names)
    kinds = _kinds(seen, [i for i, n in enumerate(names) if n not in given])
    out = [typed(F.col(f"c{i}"), given.get(name) or kinds[i]).alias(name) for i, name in enumerate(names)]
    return Delimited(cells(data, aligned).select(*out), bad)


def _bad_rows(spark: SparkSession, path: str, comment: str | None, wrong: Column, has_header: bool) -> DataFrame:
    lines = _counted(text_lines(spark, path), comment)
    if has_header:
        headers = small_side(lines.groupBy("file").agg(F.min("line_no").alias("_header")))
        lines = lines.join(headers, "file").where(F.col("line_no") > F.col("_header"))
    return lines.where(wrong).select("file", (F.col("line_no") + 1).alias("line_no"), "line")


def _tests(places) -> list[Column]:
    """Booleans over the column ``c<i>`` of each place that decide its type."""
    tests = []
    for i in places:
        c = F.col(f"c{i}")
        tests += [
            F.bool_and(c.rlike(_INT) & c.try_cast("long").isNotNull()).alias(f"int{i}"),
            F.bool_and(c.rlike(_FLOAT)).alias(f"float{i}"),
            F.bool_or(c.rlike(r"^[+-]?0\d+$")).alias(f"zeros{i}"),
        ]
    return tests


def _kinds(rows: list[Row], places) -> dict[int, str]:
    """long, double or string per column, from the booleans of parts of its values; null where a part has none."""
    kinds = {}
    for i in places:
        whole, real = ([row[f"{test}{i}"] for row in rows if row[f"{test}{i}"] is not None] for test in ("int", "float"))
        if not whole or any(row[f"zeros{i}"] for row in rows):
            kinds[i] = "string"
        else:
            kinds[i] = "long" if all(whole) else "double" if all(real) else "string"
    return kinds


def _inferred(values: DataFrame, places: list[int]) -> dict[int, str]:
    """The types of columns from every value: one pass, one row of booleans."""
    return _kinds([values.agg(*_tests(places)).first()], places) if places else {}


def write_bad_rows(bad: DataFrame, path: str) -> None:
    """``line<TAB>text`` lines of the malformed rows."""
    bad.orderBy("file", "line_no").select(
        F.concat(F.col("line_no").cast("string"), F.lit("\t"), F.col("line")).alias("value")
    ).write.text(path)


# Columns of layouts without a header line of their own.
NAMED_LAYOUTS = {
    "bim": "CHROM string, ID string, CM double, POS long, ALT string, REF string",
    "fam": "FID string, IID string, PAT string, MAT string, SEX int, PHENO1 string",
    "outfmt6": "qseqid string, sseqid string, pident double, length long, mismatch long, gapopen long, "
    "qstart long, qend long, sstart long, send long, evalue double, bitscore double",
    "bedpe": "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, name string, "
    "score string, strand1 string, strand2 string",
}
# Columns that a layout's lines may leave out: all lines do or none does.
_OPTIONAL = {"bim": ["CM"], "bedpe": ["name", "score", "strand1", "strand2"]}


def read_named(spark: SparkSession, path: str, layout: str, on_bad_row: str = "stop") -> DataFrame:
    """A table without a header whose columns are known: bim, fam, outfmt6, bedpe.

    Cells are split at tabs, those of bim and fam at tabs or spaces; quotes mean nothing. A bim of five
    columns has no CM, a bedpe may end after any column from the sixth. A line with fewer fields than
    the shortest form stops the read, is skipped, or is padded with nulls (``on_bad_row`` = stop / skip
    / null); further fields are left out.
    """
    if on_bad_row not in ("stop", "skip", "null"):
        raise ValueError("on_bad_row is stop, skip or null")
    schema = T._parse_datatype_string(NAMED_LAYOUTS[layout])
    lines = spark.read.text(path).select(without_return(F.col("value")).alias("line"))
    lines = lines.where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    split = lines.withColumn("_f", F.split("line", "[\t ]" if layout in ("bim", "fam") else "\t"))
    optional = _OPTIONAL.get(layout, [])
    columns, least = list(schema), len(schema) - len(optional)
    if layout == "bim":
        # the width of most lines says whether there is a CM
        short, full = split.agg(F.count_if(F.size("_f") == least), F.count_if(F.size("_f") > least)).first()
        if short > full:
            columns = [f for f in columns if f.name not in optional]
        else:
            least = len(schema)
    wrong = F.size("_f") < least
    split = _kept_rows(split, wrong, on_bad_row, F.lit(str(least)))
    return split.select(*[typed(F.get("_f", F.lit(i)), f.dataType.simpleString()).alias(f.name) for i, f in enumerate(columns)])


def _kept_rows(split: DataFrame, wrong: Column, on_bad_row: str, wanted: Column | str) -> DataFrame:
    """Rows (line, _f) under a policy: a wrong one is an error when it is read, left out, or taken as it is."""
    if on_bad_row == "skip":
        return split.where(~wrong)
    if on_bad_row == "null":
        return split
    message = F.concat(F.lit("expected "), wanted, F.lit(" fields, got "), F.size("_f").cast("string"), F.lit(": "), F.col("line"))
    return split.where(F.when(~wrong, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_headed_layout(spark: SparkSession, path: str, layout: str, on_bad_row: str = "stop") -> DataFrame:
    """Layouts with their own header rule: pvar / psam (``#`` names after ``##`` lines), pairs
    (``#columns:``), gct (two dimension lines before the names), maf (``#`` comments).

    A line with another number of fields than the header stops the read, is skipped, or is padded with nulls and
    cut (``on_bad_row`` = stop / skip / null).
    """
    if on_bad_row not in ("stop", "skip", "null"):
        raise ValueError("on_bad_row is stop, skip or null")
    lines = text_lines(spark, path).withColumn("line", without_return(F.col("line")))

    def first(test: Column) -> str | None:
        """The first line that passes, by file and number: a top-1, not a sort."""
        found = lines.where(test).orderBy("file", "line_no").limit(1).select("line").collect()
        return found[0]["line"] if found else None

    text, comment = F.col("line"), F.col("line").startswith("#")
    if layout in ("pvar", "psam"):
        head = first(comment & ~text.startswith("##"))
        if head is None:
            return read_named(spark, path, "bim" if layout == "pvar" else "fam", on_bad_row)
        names, body = head.lstrip("#").split("\t"), ~comment
    elif layout == "pairs":
        head = first(text.startswith("#columns:")) or "#columns: readID chr1 pos1 chr2 pos2 strand1 strand2"
        names, body = head.split(":", 1)[1].split(), ~comment
    elif layout == "gct":
        head = first(F.col("line_no") == 2)
        names, body = (head or "").split("\t"), F.col("line_no") > 2
    elif layout == "maf":
        head = first(~comment)
        names, body = (head or "").split("\t"), ~comment & (text != head)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if head is None:
        raise ValueError(f"no header line in a {layout} file")
    fields = lines.where(body & (F.col("line") != "")).withColumn("_f", F.split("line", r"\t"))
    # of lines below the header only, wherever the filter is put
    fields = _kept_rows(fields, body & (F.size("_f") != len(names)), on_bad_row, F.lit(str(len(names))))
    values = fields.select(*[cell(F.get("_f", F.lit(i))).alias(f"c{i}") for i in range(len(names))])
    text = ("chrom", "chr1", "chr2", "chromosome", "readid", "name", "id")
    free = [i for i, n in enumerate(names) if n.lower() not in text]
    kinds = _inferred(values, free)
    return values.select(*[typed(F.col(f"c{i}"), kinds.get(i, "string")).alias(n) for i, n in enumerate(names)])
