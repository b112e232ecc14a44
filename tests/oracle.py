"""Run a registered query and its SQL equivalent and compare the rows."""

from __future__ import annotations

import contextlib
import datetime
import decimal
import io
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def database(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, int):
        return float(value) if abs(value) < 1 << 53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _cell(v)) for k, v in value.items()))
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(names), sorted(out, key=repr)


def plan(df, mode: str = "simple") -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


# Joins that compare every row with every row.
ALL_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def compare(spark, con, function, sql: str, sf: str) -> str | None:
    """None when equal, else what differs."""
    df = function(spark, sf)
    if any(name in plan(df) for name in ALL_PAIRS):
        return "the plan compares all pairs"
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lost = [r for r in want[1] if r not in set(got[1])][:2]
        return f"{len(got[1])} rows and {len(want[1])}; only here {extra}, only there {lost}"
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else None
