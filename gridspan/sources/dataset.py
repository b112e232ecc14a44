"""Directories of same-schema files with key=value folders."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.position import lines_by_file_number
from ..plans.scan import prefix_scan
from ..session import scratch_path, settle

_WHOLE = r"^(0|-?[1-9]\d*)$"
# Formats whose files carry a schema of their own.
MERGED = ("parquet", "orc")


def read_dataset(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """All files below ``path`` as one table, partition folders as columns after the data.

    A key whose values are all canonical whole numbers is a long; any other, such as month=01,
    is text. Every path must have the same keys. A Parquet or ORC file with columns or types that
    the first one does not have is an error; executors read the schemas. A file that lacks a column
    of the first cannot be told this way: its cells there are null.
    """
    keys = _partition_keys(spark, path, fmt)
    config = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(config, "true")
    spark.conf.set(config, "false")
    try:
        df = spark.read.options(basePath=path, **options).format(fmt).load(path)
        if fmt in MERGED:
            _check_same_schema(spark.read.options(basePath=path, mergeSchema="true").format(fmt), path, df)
    finally:
        spark.conf.set(config, before)
    if not keys:
        return df
    data = [c for c in df.columns if c not in keys]
    casts = [F.col(f"`{k}`").cast("long").alias(k) if whole else F.col(f"`{k}`") for k, whole in keys.items()]
    return df.select(*[F.col(f"`{c}`") for c in data], *casts)


def _partition_keys(spark: SparkSession, path: str, fmt: str) -> dict[str, bool]:
    """The keys of the folders, and whether all values of a key are canonical whole numbers.

    Read off the listing of the files; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = re.escape(path.rstrip("/").split(":", 1)[-1].lstrip("/"))
    inner = F.regexp_replace("path", f"^.*?{root}/", "")
    part = F.lit("([^/=]+)=([^/]*)/")
    folders = files.where(~inner.rlike(r"(^|/)[._]")).select(
        F.regexp_extract_all(inner, part, F.lit(1)).alias("keys"),
        F.transform(F.regexp_extract_all(inner, part, F.lit(2)), lambda v: v.rlike(_WHOLE)).alias("whole"),
    )
    found = folders.groupBy("keys").agg(F.count("*").alias("files")).orderBy("keys").limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"folders of {path} do not have the same keys: {found[0]['keys']} and {found[1]['keys']}")
    if not found or not found[0]["keys"]:
        return {}
    names = found[0]["keys"]
    tests = folders.agg(*[F.bool_and(F.col("whole")[i]).alias(f"w{i}") for i in range(len(names))]).first()
    return dict(zip(names, tests, strict=True))


def _check_same_schema(reader: DataFrameReader, path: str, df: DataFrame) -> None:
    """Raise when the schemas of all files, merged, hold more than the first one's."""
    try:
        merged = reader.load(path).schema
    except (PySparkException, Py4JJavaError) as clash:
        raise ValueError(f"files of {path} have different schemas") from clash
    want = {f.name: f.dataType for f in df.schema}
    other = [f.name for f in merged if want.get(f.name) != f.dataType]
    if other:
        raise ValueError(f"files of {path} have different schemas: {', '.join(other)} not as in the first file")


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def read_records(spark: SparkSession, path: str, whole_files: bool = False, schema=None) -> DataFrame:
    """JSON records: one per line, or (``whole_files``) files that hold one array of them.

    A file with an array is read by as many tasks as it has splits; see :func:`element_texts`. Its elements
    are parsed as lines would be: with a ``schema`` straight away, without one from a copy with one in each record,
    which the inference and the read share.
    """
    if not whole_files:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    texts = element_texts(spark, path).select("text")
    if schema is None:
        copy = scratch_path(spark, "records")
        # elements may hold line breaks; this sign stands in no JSON text
        texts.write.option("lineSep", "\x1e").text(copy)
        return spark.read.option("lineSep", "\x1e").json(copy)
    return texts.select(F.from_json("text", schema).alias("_record")).select("_record.*")


def _nesting(pieces: Column) -> Column:
    """Opening less closing brackets in pieces of text."""
    text = F.array_join(pieces, "")
    marks = lambda kinds: F.length(text) - F.length(F.translate(text, kinds, ""))
    return (marks("[{") - marks("]}")).cast("long")


def element_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the elements of the one JSON array in each file, whole; or the file's objects.

    The text is cut behind every closing brace, as lines are cut, so that splits of a file are read apart. What a
    cut does to the state of a reader is a function that can be joined with the next one's: whether it changes
    between inside and outside a string, and by how much the nesting grows, for a start outside and for one
    inside. Scanned over the cuts, these tell which braces end an element; the rest is a grouping by element.

    An element that is no object is part of the text of the next one. A file that ends within an element or a
    string, or goes on behind its array, is an error. Files without elements give no rows.
    """
    lines, files, tasks = lines_by_file_number(spark, path, "}")
    # no state survives a cut but these two: a brace behind a backslash is what it escapes
    pieces = F.split(F.regexp_replace("line", r"(?s)\\.", ""), '"')
    even, odd = F.filter(pieces, lambda x, i: i % 2 == 0), F.filter(pieces, lambda x, i: i % 2 == 1)
    quotes = F.size(pieces) - 1
    array = F.when(F.col("line_no") == 0, F.ltrim(F.translate("line", "\ufeff\t\r\n", "    ")).startswith("["))
    cuts = lines.select(
        "file_no", "line_no", (quotes % 2).cast("long").alias("turn"), array.alias("array"), F.col("line").rlike(r"^\s*$").alias("blank"),
        (_nesting(even) - (quotes % 2 == 0).cast("long")).alias("outside"), (_nesting(odd) - (quotes % 2 == 1).cast("long")).alias("inside"),
    )
    cuts = prefix_scan(cuts, ["file_no"], "line_no", {"_turns": ("sum_before", F.col("turn")), "_array": ("last", F.col("array"))}, tasks=tasks)
    free = (F.col("_turns") + F.col("turn")) % 2 == 0
    step = F.when(F.col("_turns") % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    cuts = cuts.select("file_no", "line_no", "_array", "blank", free.alias("free"), step.alias("step"))
    cuts = prefix_scan(cuts, ["file_no"], "line_no", {"_depth": ("sum", F.col("step"))}, tasks=tasks)
    ends = F.col("free") & (F.col("_depth") == F.col("_array").cast("int"))
    cuts = prefix_scan(cuts.withColumn("ends", ends), ["file_no"], "line_no", {"record": ("sum_before", F.col("ends").cast("long"))}, tasks=tasks)
    cuts = settle(cuts.select("file_no", "line_no", "_array", "blank", "free", "_depth", "ends", "record"))

    last = cuts.groupBy("file_no").agg(F.max(F.struct("line_no", "free", "_depth", "_array", "blank")).alias("end"), F.min("_depth").alias("least"))
    # behind an array, or blanks after an object, there is one brace more than in the file
    whole = F.col("end.free") & (F.col("end._depth") == -(F.col("end._array") | F.col("end.blank")).cast("int")) & (F.col("least") == F.col("end._depth"))
    broken = lookup_join(last.where(~whole), files, ["file_no"]).orderBy("file").first()
    if broken is not None:
        raise ValueError(f"the JSON array of {broken['file']} ends too early, or not at the end of the file")
    place = ["file_no", "line_no"]
    parts = lines.repartition(tasks, *place).join(cuts.select(*place, "record", "_array").repartition(tasks, *place), place)
    part = F.struct("line_no", F.concat("line", F.lit("}")).alias("text")).alias("part")
    # a group holds one element
    joined = parts.select("file_no", "record", "_array", part).repartition(tasks, "file_no", "record").groupBy("file_no", "record", "_array").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    rest = r"^[\s\x{feff}]*,?\s*(\[\s*)?\]\s*\}$"
    found = joined.select("file_no", "record", F.when(F.col("_array"), F.regexp_replace(text, r"^[\s\x{feff}]*[\[,]", "")).otherwise(text).alias("text"), (F.col("_array") & text.rlike(rest)).alias("rest"))
    kept = found.where(~F.col("rest") & ~F.col("text").rlike(r"^\s*\}$"))
    return lookup_join(kept, files, ["file_no"]).select("file", "record", "text")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines as a table with the one column ``line``."""
    return spark.read.text(path).withColumnRenamed("value", "line")
