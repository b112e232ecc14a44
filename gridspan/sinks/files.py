"""Writers: delimited text, JSON lines, Markdown, Parquet, plain lines.

All are Spark writes: parts appear only when the whole job has committed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import FLOATS, grouped_digits, is_number, text_of
from ..operators.compare import fingerprint
from ..plans.joins import small_side
from ..session import settle

COMPRESSIONS = ("zstd", "snappy", "gzip", "lz4", "none")
PROVENANCE = "_provenance"


def _normal(path: str) -> str:
    """The path without scheme and doubled slashes."""
    return re.sub("/+", "/", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", path)).rstrip("/")


def refuse_overlap(df: DataFrame, path: str) -> None:
    """Refuse an output that is, holds, or lies inside an input of the frame."""
    target = _normal(path)
    for source in df.inputFiles():
        source = _normal(source)
        if source == target or source.startswith(target + "/") or target.startswith(source + "/"):
            raise ValueError(f"{path} is an input of this table")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as its cell text; null stays null."""
    return df.select(*[text_of(df, c).alias(c) for c in df.columns])


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, mode: str = "error") -> None:
    """Separated text with RFC 4180 quoting; nested cells as text, null as an empty field."""
    refuse_overlap(df, path)
    as_text(df).write.mode(mode).option("emptyValue", '""').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false"
    ).option("ignoreTrailingWhiteSpace", "false").csv(path, sep=sep, header=header, nullValue="")


def _finite(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null at any depth, as JSON has none."""
    if isinstance(kind, FLOATS):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda k, v: _finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [_finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    return value


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row: nested values as arrays and objects, nulls written out."""
    cells = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    refuse_overlap(df, path)
    json_rows(df).write.mode(mode).text(path)


def _write_marked(rows: DataFrame, wanted: tuple[int, int], path: str, mode: str) -> bool:
    """Write rows (i, low, high, value) with a bracket before each ``low`` and behind each ``high``.

    The ends come from a pass of its own. Whether the rows lay in the same places in both is observed while
    they are written: ``wanted`` are the arrays and rows of that pass. False if not.
    """
    seen = Observation()
    first, last = F.col("i") == F.col("low"), F.col("i") == F.col("high")
    marked = rows.observe(seen, F.count(F.when(first, 1)).alias("first"), F.count(F.when(last, 1)).alias("last"), F.count("*").alias("rows"))
    text = F.concat(F.when(first, "[").otherwise(""), "value", F.when(last, "]").otherwise(","))
    marked.select(text.alias("value")).write.mode(mode).text(path)
    return (seen.get["first"], seen.get["last"], seen.get["rows"]) == (wanted[0], wanted[0], wanted[1])


def _write_arrays(df: DataFrame, path: str, mode: str, per_part: bool) -> None:
    refuse_overlap(df, path)

    def attempt(values: DataFrame, how: str) -> bool:
        rows = values.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), "value")
        ends = [F.min("i").alias("low"), F.max("i").alias("high"), F.count("*").alias("n")]
        if per_part:
            # a row per partition
            table = small_side(rows.groupBy("p").agg(*ends))
            wanted = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
            return _write_marked(rows.join(table, "p"), tuple(wanted), path, how)
        low, high, n = rows.agg(*ends).first()
        if not n:
            values.sparkSession.range(0, 1, 1, 1).select(F.lit("[]").alias("value")).write.mode(how).text(path)
            return True
        return _write_marked(rows.withColumns({"low": F.lit(low), "high": F.lit(high)}), (1, n), path, how)

    values = json_rows(df)
    if not attempt(values, mode):
        # rows that come in other partitions from pass to pass are settled
        attempt(settle(values), "overwrite")


def write_json_array(df: DataFrame, path: str, mode: str = "error") -> None:
    """Each part file is one JSON array of its rows; a part without rows is no array.

    Which rows begin and end a part is counted in a pass before, so the rows are not kept in between;
    readers of arrays take the parts one by one.
    """
    _write_arrays(df, path, mode, True)


def write_one_json_array(df: DataFrame, path: str, mode: str = "error") -> None:
    """All part files, joined in the order of their names, are one JSON array of all rows.

    No part is an array by itself, and no task writes more than its part: only the first row of all has the
    opening bracket and only the last one the closing one, wherever empty parts lie. Without rows it is ``[]``.
    """
    _write_arrays(df, path, mode, False)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Table rows as Markdown lines: pipes escaped, line breaks as <br>, digits grouped."""
    cells = []
    for f in df.schema:
        text = text_of(df, f.name)
        if is_number(f.dataType) and not isinstance(f.dataType, FLOATS + (T.DecimalType,)):
            text = grouped_digits(F.col(f"`{f.name}`"))
        text = F.replace(text, F.lit("|"), F.lit("\\|"))
        cells.append(F.coalesce(F.regexp_replace(text, "\r\n|\n|\r", "<br>"), F.lit("")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_header(df: DataFrame) -> list[str]:
    names = [c.replace("|", "\\|") for c in df.columns]
    return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]


def write_markdown(df: DataFrame, path: str, mode: str = "error") -> None:
    """Row lines as text parts; the two header lines are :func:`markdown_header`."""
    refuse_overlap(df, path)
    markdown_rows(df).write.mode(mode).text(path)


def write_parquet(
    df: DataFrame,
    path: str,
    compression: str = "zstd",
    provenance: dict[str, str] | None = None,
    with_fingerprint: bool = False,
    mode: str = "error",
) -> None:
    """Parquet with a record of where the view comes from beside it.

    ``provenance`` (source, filter, select, sort, …) goes to the first column's metadata, which
    stays in the files, and to ``<path>/_provenance``. ``with_fingerprint`` adds the value
    fingerprint of the rows as written, which :func:`verify_fingerprint` checks.
    """
    if compression not in COMPRESSIONS:
        raise ValueError(f"compression is one of {', '.join(COMPRESSIONS)}")
    refuse_overlap(df, path)
    spark = df.sparkSession
    record = dict(provenance or {})
    out = df
    if record:
        first = df.columns[0]
        kept = {**df.schema[first].metadata, "provenance": json.dumps(record, sort_keys=True)}
        out = df.withMetadata(first, kept)
    codec = "uncompressed" if compression == "none" else compression
    out.write.mode(mode).option("compression", codec).parquet(path)
    if with_fingerprint:
        # taken from the rows as stored, so nothing the writer changes goes unseen
        record["fingerprint"] = fingerprint(spark.read.parquet(path)).first()["fingerprint"]
    if record:
        rows = [(json.dumps(record, sort_keys=True),)]
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{PROVENANCE}")


def read_provenance(spark: SparkSession, path: str) -> dict[str, str]:
    rows = spark.read.text(f"{path}/{PROVENANCE}").limit(1).collect()
    return json.loads(rows[0]["value"]) if rows else {}


def verify_fingerprint(spark: SparkSession, path: str) -> bool:
    """Whether the rows are still those whose fingerprint was recorded."""
    recorded = read_provenance(spark, path).get("fingerprint")
    if recorded is None:
        raise ValueError(f"{path} records no fingerprint")
    return fingerprint(spark.read.parquet(path)).first()["fingerprint"] == recorded


def write_lines(df: DataFrame, path: str, column: str = "line", mode: str = "error") -> None:
    """Lines as they are."""
    refuse_overlap(df, path)
    df.select(F.col(f"`{column}`").alias("value")).write.mode(mode).text(path)
