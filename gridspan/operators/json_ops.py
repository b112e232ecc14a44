"""JSON text columns: leaf paths, validity, records at a path."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Possessive, so that long strings need no stack.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_SCALAR = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null"
# What a string, a number or a word may begin with: a text that is cut anywhere still has these tokens.
_STRING_BEGUN = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+(?:"|\\(?:u[0-9a-fA-F]{0,3})?+)?+'
_NUMBER_BEGUN = r"(?:0|[1-9][0-9]*+)(?:\.(?:[0-9]++(?:[eE][+-]?+[0-9]*+)?+)?+|[eE][+-]?+[0-9]*+)?+"
_SCALAR_BEGUN = rf"-(?:{_NUMBER_BEGUN})?+|{_NUMBER_BEGUN}|t(?:r(?:ue?+)?+)?+|f(?:a(?:l(?:se?+)?+)?+)?+|n(?:u(?:ll?+)?+)?+"
_TOKEN = rf"[ \t\n\r]++|[\[\]{{}},:]|{_STRING_BEGUN}|{_SCALAR_BEGUN}|(?s:.)"
_VALUE = "[\u0001\u0002]"
_CONTAINER = (
    rf"\{{(?:\x01:{_VALUE}(?:,\x01:{_VALUE})*+)?+\}}|\[(?:{_VALUE}(?:,{_VALUE})*+)?+\]"
)


def _depth(text: Column) -> Column:
    """Greatest nesting of brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]++", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("top"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("{", "["), 1).when(mark.isin("}", "]"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state["top"], now).alias("top"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda s: s["top"])


def json_paths(df: DataFrame, column: str, prefix: Column | None = None) -> DataFrame:
    """A row per leaf of each JSON text: the other columns, path and value (as JSON text).

    Paths are written as jq does: ``.key``, ``["odd key"]``, ``[i]``; empty objects and arrays are
    leaves; ``prefix`` (for records, ``concat('.[', i, ']')``) comes before. One pass: each level
    of nesting explodes the containers and leaves the rest, to the depth the data has. Numbers
    show in their normalised form. A text that is not valid JSON gives one row with a null path; a
    null text gives none. Of a key that repeats within an object the last value shows; for that, the
    session lets variants repeat keys from here on.
    """
    others = [c for c in df.columns if c != column]
    text = F.col(f"`{column}`")
    depth = df.agg(F.max(_depth(text))).first()[0] or 0
    spark = df.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    start = prefix if prefix is not None else F.lit("")
    work = df.where(text.isNotNull()).select(
        *[F.col(f"`{c}`") for c in others], start.alias("_path"), F.try_parse_json(text).alias("_v")
    )
    for _ in range(depth):
        parts = spark.tvf.variant_explode_outer(F.col("_v").outer()).toDF("_i", "_key", "_child")
        joined = work.lateralJoin(parts)
        plain = F.col("_key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        quoted = F.concat(F.lit("["), F.to_json(F.to_variant_object(F.array("_key"))), F.lit("]"))
        quoted = F.regexp_replace(quoted, r"^\[\[(.*)\]\]$", "[$1]")
        inside = F.concat(F.lit("["), F.col("_i").cast("string"), F.lit("]"))
        # a bracket right at the start follows a dot
        dot = F.when(F.col("_path") == "", ".").otherwise("")
        step = (
            F.when(F.col("_key").isNull(), F.concat(dot, inside))
            .when(plain, F.concat(F.lit("."), "_key"))
            .otherwise(F.concat(dot, quoted))
        )
        opened = F.col("_i").isNotNull()
        work = joined.select(
            *[F.col(f"`{c}`") for c in others],
            F.when(opened, F.concat("_path", step)).otherwise(F.col("_path")).alias("_path"),
            F.when(opened, F.col("_child")).otherwise(F.col("_v")).alias("_v"),
        )
    path = F.when(F.col("_v").isNull(), None).when(F.col("_path") == "", ".").otherwise(F.col("_path"))
    return work.select(*[F.col(f"`{c}`") for c in others], path.alias("path"), F.to_json("_v").alias("value"))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value as RFC 8259 has it; a key may repeat within an object.

    Strings, numbers and words become one mark each; then containers of marks become marks, from the innermost
    out, as often as brackets are nested.
    """
    # marks that cannot stand in a valid text outside a string: 1 a string, 2 any other value
    marked = F.regexp_replace(text, _STRING, "\u0001")
    marked = F.regexp_replace(marked, _SCALAR, "\u0002")
    marked = F.regexp_replace(marked, r"[ \t\n\r]+", "")
    depth = F.greatest(_depth(text), F.lit(0))
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    whole = F.aggregate(rounds, marked, lambda now, _: F.regexp_replace(now, _CONTAINER, "\u0002"))
    return ~text.rlike("[\u0001\u0002]") & whole.isin("\u0001", "\u0002")


def invalid_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is there but is not valid JSON; an object that repeats a key is valid."""
    text = F.col(f"`{column}`")
    return df.where(text.isNotNull() & ~is_json(text))


# States between two tokens, and what is wrong when none of what they take comes.
_VALUE_NEXT, _ITEM_NEXT, _KEY_NEXT, _FIELD_NEXT, _COLON_NEXT, _IN_OBJECT, _IN_ARRAY, _DONE = "vikfcoad"
_WRONG = {
    _VALUE_NEXT: "a value is expected",
    _ITEM_NEXT: "a value or ] is expected",
    _KEY_NEXT: "a key is expected",
    _FIELD_NEXT: "a key or } is expected",
    _COLON_NEXT: "a colon is expected",
    _IN_OBJECT: "a comma or } is expected",
    _IN_ARRAY: "a comma or ] is expected",
    _DONE: "there is text after the value",
}


def _after(stack: Column) -> Column:
    """The state after a value, by the bracket it is in."""
    last = F.right(stack, F.lit(1))
    return F.when(last == "{", _IN_OBJECT).when(last == "[", _IN_ARRAY).otherwise(_DONE)


def _error(text: Column) -> Column:
    """Byte and cause of the first error of a text, by a fold over its tokens; the byte is null in a valid text.

    The fold's state is what may come next, the open brackets, and how many bytes were read.
    """
    start = F.struct(
        F.lit(_VALUE_NEXT).alias("next"), F.lit("").alias("open"), F.lit(0).cast("long").alias("at"),
        F.lit(None).cast("long").alias("bad"), F.lit(None).cast("string").alias("why"),
    )

    def step(state: Column, token: Column) -> Column:
        now, stack, size = state["next"], state["open"], F.octet_length(token)
        value = now.isin(_VALUE_NEXT, _ITEM_NEXT)
        key = now.isin(_KEY_NEXT, _FIELD_NEXT)
        string, scalar = token.startswith('"'), token.rlike(r"^[-0-9tfn]")
        whole = F.when(string, (size > 1) & token.endswith('"') & token.rlike(rf"^{_STRING}$")).otherwise(token.rlike(rf"^(?:{_SCALAR})$"))
        closes = ((token == "}") & now.isin(_FIELD_NEXT, _IN_OBJECT)) | ((token == "]") & now.isin(_ITEM_NEXT, _IN_ARRAY))
        outer = F.substring(stack, F.lit(1), F.length(stack) - 1)
        opened = F.when(value & token.isin("{", "["), F.concat(stack, token)).when(closes, outer).otherwise(stack)
        following = (
            F.when(token.rlike(r"^[ \t\n\r]"), now)
            .when(value & (token == "{"), _FIELD_NEXT)
            .when(value & (token == "["), _ITEM_NEXT)
            .when(closes, _after(outer))
            .when(value & (string | scalar) & whole, _after(stack))
            .when(key & string & whole, _COLON_NEXT)
            .when((now == _COLON_NEXT) & (token == ":"), _VALUE_NEXT)
            .when((now == _IN_OBJECT) & (token == ","), _KEY_NEXT)
            .when((now == _IN_ARRAY) & (token == ","), _VALUE_NEXT)
        )
        # a token that might have gone on is wrong behind its end, any other where it begins
        begun = (value & (string | scalar)) | (key & string)
        cause = F.when(begun & string, "a string is broken off, or holds what must be escaped").when(begun, "a number or word is broken off")
        cause = F.coalesce(cause, F.create_map(*[F.lit(x) for pair in _WRONG.items() for x in pair])[now])
        fails = following.isNull()
        then = F.struct(
            following.alias("next"), opened.alias("open"), (state["at"] + size).alias("at"),
            F.when(fails, state["at"] + F.when(begun, size).otherwise(0)).alias("bad"), F.when(fails, cause).alias("why"),
        )
        return F.when(state["bad"].isNotNull(), state).otherwise(then)

    end = F.aggregate(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), F.lit(1)), start, step)
    early = F.struct(F.octet_length(text).cast("long").alias("byte"), F.lit("the text ends too early").alias("cause"))
    found = F.struct(end["bad"].alias("byte"), end["why"].alias("cause"))
    cut = end["bad"].isNull() & (end["next"] != _DONE) | (end["bad"] == F.octet_length(text))
    return F.when(cut, early).otherwise(found)


def json_errors(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text is no valid JSON: the other columns, byte, line, column and cause of the first error.

    The error is at the first byte with which the text can no longer become one JSON value, counted from 0;
    lines, and bytes within a line, count from 1. In a text that only ends too early it is the byte after the end.
    Only texts that :func:`is_json` refuses are folded, each by itself. Null texts give no row.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    bad = invalid_json(df, column).select(*others, F.col(f"`{column}`").alias("_text"))
    bad = bad.withColumn("_error", _error(F.col("_text")))
    before = F.substring(F.col("_text").cast("binary"), F.lit(1), F.col("_error.byte").cast("int")).cast("string")
    line = F.octet_length(before) - F.octet_length(F.translate(before, "\n", "")) + 1
    at = F.octet_length(F.substring_index(before, "\n", -1)) + 1
    return bad.select(*others, F.col("_error.byte").alias("byte"), line.alias("line"), at.alias("column"), F.col("_error.cause").alias("cause"))


def records_at(df: DataFrame, column: str, path: str, schema: str | T.DataType) -> DataFrame:
    """The objects of the array at ``path`` (``.features``, ``.a.b``) as a table, with the other
    columns kept in front."""
    steps = re.findall(r"\.([A-Za-z_][A-Za-z0-9_]*)", path)
    if "".join(f".{s}" for s in steps) != path:
        raise ValueError(f"cannot read path {path!r}")
    kind = schema if isinstance(schema, T.DataType) else T._parse_datatype_string(schema)
    whole: T.DataType = T.ArrayType(kind)
    for step in reversed(steps):
        whole = T.StructType([T.StructField(step, whole)])
    parsed = F.from_json(F.col(f"`{column}`"), whole)
    for step in steps:
        parsed = parsed.getField(step)
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    return df.select(*others, F.explode(parsed).alias("_record")).select(*others, "_record.*")
