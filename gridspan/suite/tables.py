"""Queries on the general operators: filters, columns, summaries, order, compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith
from ..functions.cells import grouped_digits, text_of
from ..operators import compare, compute, distinct_rows, order, reshape, select, summary
from ..operators import filter as rows
from ..plans.position import numbered_by, numbered_parquet
from .base import query, shares, table

Spark = SparkSession

_SLICE = (
    "SELECT l_returnflag AS value, count(*) AS count, count(*) / sum(count(*)) OVER () AS fraction FROM lineitem "
    "WHERE l_quantity > 25 AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_linestatus IN ('O', 'F') GROUP BY 1"
)


@query("A6_value_counts_of_recent_large_lines", _SLICE)
def recent_large(spark: Spark, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    kept = rows.keep_rows(
        df, ("l_quantity", ">", 25), ("l_shipdate", ">=", "1998-01-01"), ("l_linestatus", "in", ["O", "F"])
    )
    return summary.value_counts(kept, "l_returnflag")


@query(
    "S1_parquet_scan",
    "SELECT l_orderkey, l_tax FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_tax > 0.05",
)
def parquet_scan(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = rows.keep_rows(df, ("l_returnflag", "in", ["A", "R"]), ("l_tax", ">", 0.05))
    return kept.select("l_orderkey", "l_tax")


@query(
    "F1_compare",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 250000.5 "
    "AND o_orderstatus != 'F' AND o_custkey <= 700",
)
def compare_atoms(spark, sf):
    df = table(spark, sf, "orders")
    return rows.keep_rows(
        df, ("o_totalprice", ">=", "100000"), ("o_totalprice", "<", 250000.5), ("o_orderstatus", "!=", "F"),
        ("o_custkey", "<=", 700),
    ).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "F1_not_a_number_and_float",
    "WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_tax AS FLOAT) AS f, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS d, "
    "l_linenumber = 3 AS odd FROM lineitem) SELECT count(*) AS n, count(CASE WHEN f = CAST(0.05 AS FLOAT) THEN 1 END) AS f_equal, "
    "count(CASE WHEN NOT odd AND d > 0.05 THEN 1 END) AS above, count(CASE WHEN (odd AND d IS NOT NULL) OR d <> 0.05 THEN 1 END) AS other FROM t",
)
def nan_rules(spark, sf):
    df = table(spark, sf, "lineitem").select(
        F.col("l_tax").cast("float").alias("f"),
        F.when(F.col("l_linenumber") == 7, None)
        .when(F.col("l_linenumber") == 3, float("nan"))
        .otherwise(F.col("l_discount"))
        .alias("d"),
    )
    hit = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count("*").alias("n"),
        hit(rows.where(df, "f", "==", 0.05)).alias("f_equal"),
        hit(rows.where(df, "d", ">", 0.05)).alias("above"),
        hit(rows.where(df, "d", "!=", 0.05)).alias("other"),
    )


@query(
    "F2_time_literals",
    "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 03:30:00' AND ts < TIMESTAMP '2024-01-05 00:00:00'",
)
def time_literals(spark, sf):
    df = table(spark, sf, "events")
    kept = rows.keep_rows(df, ("ts", ">=", "2024-01-02 05:30:00+02:00"), ("ts", "<", "2024-01-05"))
    return kept.select("event_id", "user_id")


@query(
    "F3_regular_expression",
    "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(red|blue) [bw]') AND NOT regexp_matches(p_brand, '1$')",
)
def regex(spark, sf):
    df = table(spark, sf, "part")
    return rows.keep_rows(df, ("p_name", "~", "(red|blue) [bw]"), ("p_brand", "!~", "1$")).select(
        "p_partkey", "p_name"
    )


@query(
    "F4_text_tests",
    "SELECT p_partkey FROM part WHERE contains(p_name, 'in') AND starts_with(p_brand, 'Brand#1') AND suffix(p_type, 'Y')",
)
def text_tests(spark, sf):
    df = table(spark, sf, "part")
    atoms = (("p_name", "contains", "in"), ("p_brand", "startswith", "Brand#1"), ("p_type", "endswith", "Y"))
    return rows.keep_rows(df, *atoms).select("p_partkey")


@query(
    "F5_membership",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber IN (1, 3) AND l_linestatus NOT IN ('F')",
)
def membership(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = rows.keep_rows(df, ("l_linenumber", "in", [1, "3"]), ("l_linestatus", "not in", ["F"]))
    return kept.select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "F6_membership_by_table",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def members(spark, sf):
    listed = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return rows.members_of(table(spark, sf, "orders"), "o_custkey", listed).select("o_orderkey", "o_custkey")


@query(
    "F6_outside_a_table",
    "SELECT o_orderkey, k FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS k FROM orders) t "
    "WHERE k IS NOT NULL AND k NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
)
def not_members(spark, sf):
    listed = table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k")
    )
    return rows.members_of(df, "k", listed, keep=False)


@query(
    "F7_nulls",
    "SELECT count(CASE WHEN v IS NULL THEN 1 END) AS missing, count(CASE WHEN v IS NOT NULL THEN 1 END) AS present "
    "FROM (SELECT CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS v FROM lineitem) t",
)
def nulls(spark, sf):
    df = table(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 40, F.col("l_quantity")).alias("v"))
    hit = lambda op: F.count(F.when(rows.where(df, "v", op), 1))
    return df.agg(hit("is null").alias("missing"), hit("is not null").alias("present"))


@query(
    "F8_bit_flags",
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 4096 AS BIGINT) AS flag FROM lineitem "
    "WHERE (l_partkey % 4096) & 65 = 65 AND (l_partkey % 4096) & 1284 = 0",
)
def flags(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 4096).alias("flag")
    )
    return rows.keep_rows(df, ("flag", "has", "PAIRED,READ1"), ("flag", "lacks", "UNMAP,SECONDARY,DUP"))


@query("F9_boolean", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) = true AND (o_custkey % 2 = 0) != true")
def booleans(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_totalprice") > 200000).alias("large"), (F.col("o_custkey") % 2 == 0).alias("even")
    )
    return rows.keep_rows(df, ("large", "==", True), ("even", "!=", True)).select("o_orderkey")


@query(
    "F10_and_or",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000 OR o_orderpriority = '1-URGENT' AND o_custkey < 100",
)
def and_or(spark, sf):
    df = table(spark, sf, "orders")
    w = lambda *a: rows.where(df, *a)
    test = rows.any_of(
        rows.all_of(w("o_orderstatus", "==", "P"), w("o_totalprice", ">", 400000)),
        rows.all_of(w("o_orderpriority", "==", "1-URGENT"), w("o_custkey", "<", 100)),
    )
    return df.where(test).select("o_orderkey")


@query(
    "F11_narrow_by_values",
    "SELECT doc_id, lang FROM documents WHERE (lang IN (SELECT min(lang) FROM documents) OR lang IS NULL) "
    "AND source IS NOT NULL AND source NOT IN (SELECT max(source) FROM documents)",
)
def narrowed(spark, sf):
    df = table(spark, sf, "documents")
    lang, source = df.agg(F.min("lang"), F.max("source")).first()
    test = rows.narrow(df, "lang", [lang, None]) & rows.narrow(df, "source", [source, None], keep=False)
    return df.where(test).select("doc_id", "lang")


@query(
    "F12_search_all_columns",
    "SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, '(?i)ECON|blue') THEN 'p_name' END, "
    "CASE WHEN regexp_matches(p_brand, '(?i)ECON|blue') THEN 'p_brand' END, CASE WHEN regexp_matches(p_type, '(?i)ECON|blue') THEN 'p_type' END) "
    "AS matched FROM part WHERE regexp_matches(p_name || ' ' || p_brand || ' ' || p_type, '(?i)ECON|blue')",
)
def search(spark, sf):
    found = rows.search(table(spark, sf, "part"), "econ|BLUE")
    return found.select("p_partkey", F.array_join("matched", ",").alias("matched"))


@query(
    "F12_search_lines",
    "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t "
    "WHERE regexp_matches(line, '(?i)license') GROUP BY doc_id",
)
def search_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.search(lines, "LICENSE", ["line"]).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("F13_rows_at", "SELECT l_orderkey, l_partkey, row AS _row FROM (SELECT l_orderkey, l_partkey, row_number() OVER () - 1 AS row FROM lineitem) t WHERE row IN (0, 17, 4999)")
def rows_at(spark, sf):
    numbered = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey"])
    return rows.rows_at(numbered, "_row", [0, 17, 4999])


@query(
    "P1_select_columns",
    "SELECT l_returnflag, l_linestatus, l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount FROM lineitem",
)
def select_spec(spark, sf):
    return select.select_columns(table(spark, sf, "lineitem"), "@string,1-3,@numeric,!l_t*,!l_line[n]*")


@query(
    "P3_compute",
    "SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey + 1 AS span, (l_partkey - l_suppkey + 1) / 1000.0::DOUBLE AS kilo, "
    "CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS per, -l_partkey * 2 AS twice, "
    "round(l_extendedprice * (1 - l_discount), 7) AS net FROM lineitem",
)
def computed(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount")
    out = compute.compute(
        df,
        span=lambda n: n("l_partkey") - n("l_suppkey") + 1,
        kilo=lambda n: n("span") / 1000,
        per=lambda n: n("l_extendedprice") / n("l_discount"),
        twice=lambda n: -n("l_partkey") * 2,
        net=lambda n: n("l_extendedprice") * (1 - n("l_discount")),
    )
    return shares(out.drop("l_partkey", "l_suppkey", "l_extendedprice", "l_discount"), "net")


@query(
    "C1_overflow_is_null",
    "SELECT count(*) AS n, count(CASE WHEN l_partkey < 2 THEN 1 END) AS kept FROM lineitem",
)
def overflow(spark, sf):
    df = table(spark, sf, "lineitem").select("l_partkey")
    out = compute.compute(df, big=lambda n: n("l_partkey") * ((1 << 62) + 1) + 0)
    return out.agg(F.count("*").alias("n"), F.count("big").alias("kept"))


@query(
    "C2_divide",
    "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_totalprice / (o_custkey % 4) END AS part FROM orders",
)
def divided(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 4).alias("d"))
    return compute.compute(df, part=lambda n: n("o_totalprice") / n("d")).select("o_orderkey", "part")


@query("C3_sign", "SELECT c_custkey, abs(c_acctbal) AS size, -c_acctbal AS other, abs(c_nationkey - 12)::BIGINT AS away FROM customer")
def signs(spark, sf):
    df = table(spark, sf, "customer")
    out = compute.compute(
        df,
        size=lambda n: arith.absolute(n("c_acctbal")),
        other=lambda n: -n("c_acctbal"),
        away=lambda n: arith.absolute(n("c_nationkey") - 12),
    )
    return out.select("c_custkey", "size", "other", "away")


@query(
    "C4_logarithms",
    "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_partkey > 0 THEN log10(l_partkey) END, 9) AS ten, "
    "round(CASE WHEN l_discount > 0 THEN log2(l_discount) END, 9) AS two FROM lineitem",
)
def logs(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount")
    out = compute.compute(df, ten=lambda n: arith.log10(n("l_partkey")), two=lambda n: arith.log2(n("l_discount")))
    return shares(out.drop("l_discount"), "ten", "two", digits=9)


@query(
    "C5_round",
    "SELECT o_orderkey, round(o_totalprice) AS whole, (CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END) * "
    "((o_orderkey + 50) // 100) * 100 AS hundreds, sign(x) * floor(abs(x) + 0.5) AS half FROM "
    "(SELECT *, (o_custkey % 2 - 0.5::DOUBLE) * (o_orderkey % 7) AS x FROM orders) t",
)
def rounding(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.when(F.col("o_custkey") % 2 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("signed"),
        ((F.col("o_custkey") % 2 - F.lit(0.5)) * (F.col("o_orderkey") % 7)).alias("x"),
    )
    out = compute.compute(
        df,
        whole=lambda n: arith.rounded(n("o_totalprice")),
        hundreds=lambda n: arith.rounded(n("signed"), -2),
        half=lambda n: arith.rounded(n("x")),
    )
    return out.select("o_orderkey", "whole", "hundreds", "half")


@query(
    "C6_row_extremes",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d IS NULL THEN NULL ELSE least(d, l_tax, 0.04) END AS low, "
    "CASE WHEN d IS NULL THEN NULL ELSE greatest(d, l_tax) END AS high, greatest(l_suppkey, l_linenumber) AS whole FROM "
    "(SELECT *, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS d FROM lineitem) t",
)
def extremes(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("d", F.when(F.col("l_linenumber") != 2, F.col("l_discount")))
    out = compute.compute(
        df,
        low=lambda n: arith.smallest(n("d"), n("l_tax"), 0.04),
        high=lambda n: arith.largest(n("d"), n("l_tax")),
        whole=lambda n: arith.largest(n("l_suppkey"), n("l_linenumber")),
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "low", "high", "whole")


@query(
    "C7_length",
    "SELECT doc_id, length(text) AS chars, len(string_split(text, ' ')) AS pieces, octet_length(encode(text)) AS bytes FROM documents",
)
def lengths(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", "text", F.split("text", " ").alias("words"), F.col("text").cast("binary").alias("raw")
    )
    out = df.select(
        "doc_id",
        arith.length(df, "text").value.alias("chars"),
        arith.length(df, "words").value.alias("pieces"),
        arith.length(df, "raw").value.alias("bytes"),
    )
    return out


@query(
    "C8_times_as_numbers",
    "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 AS next_day, epoch_us(o_orderdate) // 1 AS micros, "
    "CAST(o_totalprice > 200000 AS BIGINT) + 1 AS flag FROM orders",
)
def times_as_numbers(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderdate", (F.col("o_totalprice") > 200000).alias("b")
    )
    out = compute.compute(
        df, next_day=lambda n: n("d") + 1, micros=lambda n: n("o_orderdate"), flag=lambda n: n("b") + 1
    )
    return out.select("o_orderkey", "next_day", "micros", "flag")


@query(
    "C9_cell_text",
    "SELECT c_custkey, '{key: ' || c_custkey || ', seg: ' || c_mktsegment || '}' AS record, '[' || c_nationkey || ', ' || c_custkey || ']' AS list, "
    "CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(c_nationkey / 4 AS VARCHAR) AS number FROM customer WHERE c_nationkey % 4 <> 0 "
    "UNION ALL SELECT c_custkey, '{key: ' || c_custkey || ', seg: ' || c_mktsegment || '}', '[' || c_nationkey || ', ' || c_custkey || ']', "
    "CASE WHEN c_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, CAST(c_nationkey // 4 AS VARCHAR) FROM customer WHERE c_nationkey % 4 = 0",
)
def cell_texts(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.struct(F.col("c_custkey").alias("key"), F.lit(None).cast("int").alias("gap"), F.col("c_mktsegment").alias("seg")).alias("record"),
        F.array(F.col("c_nationkey").cast("long"), "c_custkey").alias("list"),
        (F.col("c_nationkey") % 2 == 0).alias("flag"),
        (F.col("c_nationkey") / 4).alias("number"),
    )
    return df.select("c_custkey", *[text_of(df, c).alias(c) for c in ("record", "list", "flag", "number")])


@query(
    "C16_grouped_digits",
    "SELECT o_orderkey, replace(format('{:,}', o_orderkey * 1000 + 7), ',', '_') AS shown FROM orders",
)
def digits(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", grouped_digits(F.col("o_orderkey") * 1000 + 7).alias("shown"))


@query("A1_count", "SELECT count(*) AS n_rows FROM lineitem WHERE l_quantity >= 30")
def counted(spark, sf):
    df = table(spark, sf, "lineitem")
    return summary.row_count(rows.keep_rows(df, ("l_quantity", ">=", 30)))


@query("A1_count_distinct_rows", "SELECT count(*) AS n_rows FROM (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem) t")
def counted_distinct(spark, sf):
    return summary.row_count(order.distinct(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"]))


_NUMERIC = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


def _describe_sql(columns, distinct="NULL") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS min, "
        f"CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 7) AS mean, round(CAST(sum({c}) AS DOUBLE), 2) AS sum, "
        f"round(stddev_samp({c}), 7) AS std, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 7) AS p25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 7) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 7) AS p75 "
        "FROM lineitem"
        for c in columns
    )


@query("A2_describe", _describe_sql(_NUMERIC))
def described(spark, sf):
    out = summary.describe(table(spark, sf, "lineitem").select(*_NUMERIC))
    out = out.withColumns({"min": F.col("min").cast("double"), "max": F.col("max").cast("double")})
    return shares(shares(out.drop("type", "distinct"), "mean", "std", "p25", "p50", "p75"), "sum", digits=2)


_LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_TEXTS = ("l_returnflag", "l_linestatus")


@query(
    "A2_describe_whole_table",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS nulls, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, "
        f"NULL AS first, NULL AS last, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 7) AS p25, "
        f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 7) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 7) AS p75, CAST(NULL AS BIGINT) AS \"distinct\" FROM lineitem"
        for c in _LINE_NUMBERS
    )
    + "".join(
        f" UNION ALL SELECT '{c}', count({c}), count(*) - count({c}), NULL, NULL, min({c}), max({c}), NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}) FROM lineitem"
        for c in _LINE_TEXTS
    )
    + " UNION ALL SELECT 'l_shipdate', count(l_shipdate), count(*) - count(l_shipdate), NULL, NULL, strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S.%f'), strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S.%f'), "
    "NULL, NULL, NULL, NULL, NULL, NULL FROM lineitem",
)
def described_whole(spark, sf):
    """Every column of a table of mixed types."""
    out = summary.describe(table(spark, sf, "lineitem"))
    number = F.col("column").isin(*_LINE_NUMBERS)
    shown = out.select(
        "column", "count", "nulls", F.when(number, F.col("min")).cast("double").alias("low"), F.when(number, F.col("max")).cast("double").alias("high"),
        F.when(~number, F.col("min")).alias("first"), F.when(~number, F.col("max")).alias("last"), "mean", "std", "p25", "p50", "p75", "distinct",
    )
    return shares(shown, "mean", "std", "p25", "p50", "p75")


@query(
    "A3_percentiles_past_doubles",
    "WITH v AS (SELECT 9007199254740993 + 2 * l_partkey AS x, row_number() OVER (ORDER BY l_partkey) - 1 AS i, count(*) OVER () AS n FROM lineitem), "
    "s AS (SELECT k, (max(n) - 1) * k // 4 AS low, (max(n) - 1) * k % 4 AS part, max(n) AS n FROM v, range(1, 4) r(k) GROUP BY k), "
    "e AS (SELECT k, part, max(x) FILTER (WHERE i = low)::HUGEINT AS a, max(x) FILTER (WHERE i = least(low + 1, s.n - 1))::HUGEINT AS b FROM s, v GROUP BY k, part), "
    "q AS (SELECT k, 4 * a + part * (b - a) AS q FROM e) "
    "SELECT CAST(25 * k AS INTEGER) AS percent, CAST(q // 4 AS VARCHAR) || CASE q % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS value FROM q",
)
def percentiles_past_doubles(spark, sf):
    """Whole numbers that no double holds."""
    df = table(spark, sf, "lineitem").select((F.col("l_partkey") * 2 + ((1 << 53) + 1)).alias("x"))
    out = summary.describe(df, as_text=True)
    cells = F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"p{p}").alias("value")) for p in (25, 50, 75)])
    return out.select(F.inline(cells))


@query(
    "A2_describe_text",
    "SELECT 'l_returnflag' AS \"column\", 'string' AS type, count(*) AS count, min(l_returnflag) AS min, max(l_returnflag) AS max, "
    "count(DISTINCT l_returnflag) AS \"distinct\" FROM lineitem UNION ALL SELECT 'flag' , 'string', count(*), min(f), max(f), count(DISTINCT f) FROM "
    "(SELECT CAST(l_quantity AS BIGINT) || l_linestatus AS f FROM lineitem) t",
)
def described_text(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_returnflag", F.concat(F.col("l_quantity").cast("long").cast("string"), "l_linestatus").alias("flag")
    )
    return summary.describe(df, percentiles=()).select("column", "type", "count", "min", "max", "distinct")


@query(
    "A3_exact_percentiles_by_counting",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {p} AS share, round(quantile_cont({c}, {p}), 7) AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
        for p in (0.01, 0.5, 0.999)
    ),
)
def counted_percentiles(spark, sf):
    """The path for columns too large for one buffer, made to run by its row limit."""
    df = table(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")
    out = summary.describe(df, percentiles=(0.01, 0.5, 0.999), in_buffer=0)
    names = {"p1": 0.01, "p50": 0.5, "p99_9": 0.999}
    cells = F.array(*[F.struct(F.lit(p).alias("share"), F.round(F.col(n), 7).alias("value")) for n, p in names.items()])
    return out.select("column", F.inline(cells))


@query(
    "A4_describe_times",
    "SELECT 'o_orderdate' AS \"column\", count(o_orderdate) AS count, epoch_us(min(o_orderdate)) // 1 AS low, epoch_us(max(o_orderdate)) // 1 AS high, "
    "CAST(floor(quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.5)) AS BIGINT) AS middle FROM orders",
)
def described_times(spark, sf):
    out = summary.describe_times(table(spark, sf, "orders").select("o_orderdate"))
    return out.select(
        "column", "count", F.unix_micros("min").alias("low"), F.unix_micros("max").alias("high"), F.unix_micros("p50").alias("middle")
    )


@query(
    "A5_histogram",
    "WITH r AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 32 AS w FROM events), c AS (SELECT "
    "CAST(least(floor((value - lo) / w), 31) AS INTEGER) AS bin, count(*) AS n FROM events, r GROUP BY 1) "
    "SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 7) AS low, coalesce(n, 0) AS n FROM range(32) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = i",
)
def histogram(spark, sf):
    return summary.histogram(table(spark, sf, "events"), "value").select("bin", F.round("low", 7).alias("low"), "n")


_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count, count(*) / (SELECT count(*) FROM documents) AS fraction "
    f"FROM (SELECT lang, source, n_chars % 7 AS bucket FROM documents) t GROUP BY 2"
    for c in ("lang", "source", "bucket")
)


@query("A6_value_counts_of_columns", _COUNTS)
def counts_of_columns(spark, sf):
    df = table(spark, sf, "documents").withColumn("bucket", F.col("n_chars") % 7)
    return summary.value_counts_of(df, ["lang", "source", "bucket"])


@query(
    "A6_value_counts_with_null",
    "SELECT v AS value, count(*) AS count, count(*) / (SELECT count(*) FROM events) AS fraction FROM "
    "(SELECT CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS v FROM events) t GROUP BY 1",
)
def counts_with_null(spark, sf):
    df = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("v"))
    return summary.value_counts(df, "v")


@query(
    "A7_distinct_first",
    "SELECT source, lang FROM (SELECT source, lang, min(doc_id) AS f FROM documents GROUP BY 1, 2) t",
)
def distinct_first(spark, sf):
    return order.distinct(table(spark, sf, "documents"), ["source", "lang"], F.col("doc_id"))


@query(
    "A7_distinct_whole_text",
    "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
)
def distinct_text(spark, sf):
    return distinct_rows.first_of_copies(table(spark, sf, "documents"), ["text"], "doc_id")


@query(
    "A8_block_summary",
    "SELECT count(v) AS n, round(sum(v), 2) AS sum, round(avg(v), 7) AS mean, min(v) AS min, max(v) AS max FROM "
    "(SELECT l_quantity AS v FROM lineitem UNION ALL SELECT l_tax FROM lineitem UNION ALL SELECT CAST(l_linenumber AS DOUBLE) FROM lineitem) t",
)
def block(spark, sf):
    out = summary.block_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_tax", "l_linenumber"])
    return shares(shares(out, "sum", digits=2), "mean")


@query(
    "A12_matrix_profile",
    "SELECT count(*) AS stored, count(*) / (2000.0::DOUBLE * 100) AS stored_share, max(l_quantity) AS max, "
    "bool_and(l_quantity = floor(l_quantity)) AS all_whole, bool_and(l_quantity = 0) AS all_zero FROM lineitem",
)
def profile(spark, sf):
    return summary.matrix_profile(table(spark, sf, "lineitem"), "l_quantity", 2000, 100)


@query(
    "A13_cell_totals",
    "SELECT l_returnflag || l_linestatus AS cell, count(*) AS pixels, sum(l_quantity) AS sum FROM lineitem GROUP BY 1",
)
def totals(spark, sf):
    df = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("cell"), F.col("l_quantity").alias("count"))
    return summary.cell_totals(df)


@query(
    "A15_matrix_grid",
    "WITH n AS (SELECT o_orderkey AS p, unnest(['o_totalprice', 'o_custkey']) AS \"column\", unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS v "
    "FROM orders), s AS (SELECT min(v) AS lo, max(v) AS hi, (SELECT count(*) FROM orders) AS n FROM n) "
    "SELECT CAST(least(floor(p * 16 / s.n), 15) AS INTEGER) AS band, \"column\", round((avg(v) - any_value(lo)) / (any_value(hi) - any_value(lo)), 7) AS value "
    "FROM n, s GROUP BY 1, 2",
)
def grid(spark, sf):
    df = table(spark, sf, "orders")
    out = summary.matrix_grid(df, F.col("o_orderkey"), df.count(), ["o_totalprice", "o_custkey"], 16)
    return shares(out, "value")


@query(
    "O1_sort",
    "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey) - 1 AS place "
    "FROM (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders) t",
)
def sorted_rows(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 9 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice"
    )
    keys = order.sort_columns(df, ["o_orderstatus", "o_totalprice:desc"])
    return numbered_by(df, [*keys, "o_orderkey"], "place").drop("o_totalprice")


@query("O2_head", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem LIMIT 20")
def headed(spark, sf):
    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_linenumber"])
    return order.head(df, 20, F.col("_row")).drop("_row")


@query(
    "O3_tail",
    "SELECT l_orderkey, l_quantity FROM (SELECT *, row_number() OVER () AS r FROM lineitem) t WHERE l_quantity > 45 ORDER BY r DESC LIMIT 25",
)
def tailed(spark, sf):
    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return order.tail(rows.keep_rows(df, ("l_quantity", ">", 45)), 25, F.col("_row")).drop("_row")


@query(
    "O2_head_of_a_third",
    "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER () - 1 AS r, count(*) OVER () AS n FROM lineitem) t WHERE r < n // 3",
)
def headed_third(spark, sf):
    """More rows than a task should hold: cut by counting."""
    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_linenumber"])
    return order.head(df, df.count() // 3, F.col("_row")).drop("_row")


@query(
    "O4_top",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100",
)
def topped(spark, sf):
    return order.top(table(spark, sf, "orders"), ["o_totalprice:desc"], 100, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query(
    "O5_sample",
    "SELECT 1000 AS drawn, 1000 AS different, 1000 AS present FROM (SELECT count(*) AS n FROM orders) t WHERE n > 1000",
)
def sampled(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey")
    drawn = order.sample(df, 1000, ["o_orderkey"], seed=5)
    # one row for at most 1000 drawn keys, each of which is in the table once
    found = drawn.join(df, "o_orderkey", "left_semi")
    return drawn.agg(
        F.count("*").cast("int").alias("drawn"), F.count_distinct("o_orderkey").cast("int").alias("different")
    ).withColumn("present", found.agg(F.count("*").cast("int")).scalar())


@query(
    "O6_transposed_head",
    "WITH h AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2) SELECT f AS field, max(CASE WHEN o_orderkey = 0 THEN v END) AS \"0\", "
    "max(CASE WHEN o_orderkey = 1 THEN v END) AS \"1\" FROM (SELECT o_orderkey, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_orderpriority']) AS f, "
    "unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority]) AS v FROM h) t GROUP BY 1",
)
def turned(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return reshape.transposed_head(df, 2, ["o_orderkey"])


@query(
    "O6_transposed_any_number",
    "WITH h AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders) "
    "SELECT CAST(i AS INTEGER) AS place, f AS field, r AS record, v AS text FROM (SELECT r, unnest(range(3)) AS i, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS f, "
    "unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus]) AS v FROM h WHERE r < 2 * n // 3) t",
)
def turned_many(spark, sf):
    df = table(spark, sf, "orders")
    keys = [F.col("o_totalprice"), F.col("o_orderkey")]
    turned = reshape.transposed_long(df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), 2 * df.count() // 3, keys)
    return turned.where("field <> 'o_totalprice'")


@query(
    "P4_flatten",
    "SELECT s_suppkey, s_name AS \"who.name\", CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS \"who.at.nation\", "
    "CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_acctbal END AS \"who.at.balance\" FROM supplier",
)
def flattened(spark, sf):
    at = F.struct(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    df = table(spark, sf, "supplier").select(
        "s_suppkey", F.struct(F.col("s_name").alias("name"), F.when(F.col("s_nationkey") % 5 != 0, at).alias("at")).alias("who")
    )
    return reshape.flatten(df)


def _packed(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("ST="), "o_orderstatus", F.when(key % 3 == 0, ";DB").otherwise(""),
            F.lit(";PR="), F.col("o_custkey").cast("string"), F.lit(";FR="), (key % 8 / 8).cast("string"),
            F.when(key % 5 == 0, ";PR=-1").otherwise(""),
        ).alias("INFO"),
    )


@query(
    "P5_expand_found_keys",
    "SELECT o_orderkey, o_orderstatus AS \"ST\", CASE WHEN o_orderkey % 3 = 0 THEN '' END AS \"DB\", CAST(o_custkey AS VARCHAR) AS \"PR\", "
    "CAST(o_orderkey % 8 / 8 AS VARCHAR) AS \"FR\" FROM orders",
)
def expanded(spark, sf):
    return reshape.expand(_packed(spark, sf), "INFO", position=F.col("o_orderkey")).drop("INFO")


@query(
    "P5_expand_declared_keys",
    "SELECT o_orderkey, o_orderstatus AS \"ST\", o_orderkey % 3 = 0 AS \"DB\", o_custkey AS \"PR\", o_orderkey % 8 / 8 AS \"FR\" FROM orders",
)
def expanded_typed(spark, sf):
    header = [
        '##INFO=<ID=ST,Number=1,Type=String,Description="state">',
        '##INFO=<ID=DB,Number=0,Type=Flag,Description="in a, or not">',
        '##INFO=<ID=PR,Number=1,Type=Integer,Description="customer">',
        '##INFO=<ID=FR,Number=1,Type=Float,Description="share">',
    ]
    return reshape.expand(_packed(spark, sf), "INFO", header=header).drop("INFO")


@query(
    "P6_tags",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber < 5 THEN CAST(l_quantity AS BIGINT) END AS \"NM\", l_tax AS ms, "
    "CASE WHEN l_linestatus = 'F' THEN l_returnflag || ':x' END AS rg, CAST(NULL AS VARCHAR) AS zz FROM lineitem",
)
def tagged(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.array_compact(
            F.array(
                F.when(F.col("l_linenumber") < 5, F.concat(F.lit("NM:i:"), F.col("l_quantity").cast("long").cast("string"))),
                F.concat(F.lit("ms:f:"), F.col("l_tax").cast("string")),
                F.when(F.col("l_linestatus") == "F", F.concat(F.lit("rg:Z:"), "l_returnflag", F.lit(":x"))),
            )
        ).alias("optional"),
    )
    return reshape.tags(df, "optional", ["NM", "ms", "rg", "zz"]).drop("optional")


@query(
    "P9_matrix_long",
    "SELECT row, \"column\", value FROM (SELECT s_suppkey AS row, unnest(['s_nationkey', 's_acctbal', 'zero']) AS \"column\", "
    "unnest([CAST(s_nationkey AS DOUBLE), s_acctbal, 0.0::DOUBLE]) AS value FROM supplier) t WHERE value <> 0",
)
def long_matrix(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.lit(0).alias("zero"))
    return reshape.matrix_long(df, "s_suppkey")


@query(
    "R1_schema",
    "SELECT column_index AS position, column_name AS name, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN "
    "'double' WHEN 'INTEGER' THEN 'int' ELSE 'timestamp_ntz' END AS type FROM (SELECT column_index - 1 AS column_index, column_name, data_type FROM duckdb_columns() WHERE table_name = 'orders') t",
)
def schema(spark, sf):
    return summary.schema_report(table(spark, sf, "orders")).select("position", "name", "type")


def _changed(spark, sf):
    df = table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    key = F.col("o_orderkey")
    changed = df.withColumn("o_custkey", F.when(key % 101 == 0, F.lit(None)).otherwise(F.col("o_custkey")))
    changed = changed.withColumn("o_orderstatus", F.when(key % 50 == 0, "X").otherwise(F.col("o_orderstatus")))
    return df, changed.select("o_orderkey", *[c for c in reversed(df.columns) if c != "o_orderkey"])


@query(
    "R3_diff_cells",
    "SELECT o_orderkey, 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM orders WHERE o_orderkey % 101 = 0 "
    "UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 'X' FROM orders WHERE o_orderkey % 50 = 0",
)
def diffed(spark, sf):
    a, b = _changed(spark, sf)
    return compare.diff_cells(a, b, ["o_orderkey"])


@query(
    "R3_diff_summary",
    "SELECT count(*) AS rows_a, count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) AS rows_b, count(CASE WHEN o_orderkey % 7 <> 0 THEN 1 END) AS compared, "
    "count(CASE WHEN o_orderkey % 7 <> 0 AND (o_orderkey % 101 = 0 OR o_orderkey % 50 = 0) THEN 1 END) AS rows_differ, "
    "CAST(sum(CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 101 = 0)::INT + (o_orderkey % 50 = 0)::INT ELSE 0 END) AS BIGINT) AS cells_differ FROM orders",
)
def diff_totals(spark, sf):
    a, b = _changed(spark, sf)
    return compare.diff_summary(a, b.where(F.col("o_orderkey") % 7 != 0), ["o_orderkey"])


@query(
    "R3_diff_by_position",
    "SELECT r AS _row, 'l_quantity' AS \"column\", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS a, CAST(CAST(l_quantity AS BIGINT) + 1 AS VARCHAR) AS b FROM "
    "(SELECT l_quantity, l_orderkey, row_number() OVER () - 1 AS r FROM lineitem) t WHERE l_orderkey % 1000 = 3",
)
def diff_by_position(spark, sf):
    a = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    # a dense position is unique by construction
    return compare.diff_cells(a, b, ["_row"], check_unique=False)


@query(
    "R3_diff_by_digests_of_positions",
    "SELECT r AS _row, 'l_quantity' AS \"column\", CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS a, CAST(CAST(l_quantity AS BIGINT) + 1 AS VARCHAR) AS b FROM "
    "(SELECT l_quantity, l_orderkey, row_number() OVER () - 1 AS r FROM lineitem) t WHERE l_orderkey % 1000 = 3",
)
def diff_by_digests(spark, sf):
    a = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 1000 == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    return compare.diff_cells_by_digest(a, b, ["_row"], dense=True)


@query(
    "R3_diff_by_digests_of_keys",
    "SELECT o_orderkey, 'o_custkey' AS \"column\", CAST(o_custkey AS VARCHAR) AS a, CAST(NULL AS VARCHAR) AS b FROM orders WHERE o_orderkey % 101 = 0 "
    "UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 'X' FROM orders WHERE o_orderkey % 50 = 0",
)
def diff_by_key_digests(spark, sf):
    a, b = _changed(spark, sf)
    return compare.diff_cells_by_digest(a, b, ["o_orderkey"])


@query("U3_schema_diff", "SELECT * FROM (VALUES ('c_acctbal', 'only in a'), ('extra', 'only in b'), ('c_nationkey', 'type int and bigint')) t(\"column\", note)")
def schema_differences(spark, sf):
    a = table(spark, sf, "customer")
    b = a.drop("c_acctbal").withColumn("c_nationkey", F.col("c_nationkey").cast("long")).withColumn("extra", F.lit(1))
    return compare.schema_diff(a, b)


def _fingerprint_sql(cells: str, columns: str, source: str) -> str:
    sums = " || '|' || ".join(
        f"CAST(sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS BIGINT)) AS VARCHAR)" for i in range(4)
    )
    return (
        f"SELECT count(*) AS n_rows, sha256('{columns}' || '|' || CAST(count(*) AS VARCHAR) || '|' || {sums}) AS fingerprint "
        f"FROM (SELECT sha256({cells}) AS h FROM {source}) t"
    )


def _cell_sql(c: str) -> str:
    return f"(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR))"


@query(
    "R4_fingerprint",
    _fingerprint_sql(" || '|' || ".join(map(_cell_sql, ("n_nationkey", "n_name", "n_regionkey"))), "n_nationkey|n_name|n_regionkey", "nation"),
)
def fingerprinted(spark, sf):
    return compare.fingerprint(table(spark, sf, "nation"))


@query(
    "R4_fingerprint_in_order",
    _fingerprint_sql(
        "r || '@|' || " + " || '|' || ".join(map(_cell_sql, ("l_orderkey", "l_partkey", "l_returnflag"))),
        "l_orderkey|l_partkey|l_returnflag",
        "(SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER () - 1 AS r FROM lineitem) q",
    ),
)
def fingerprinted_in_order(spark, sf):
    df = numbered_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_returnflag"])
    return compare.fingerprint(df, ["l_orderkey", "l_partkey", "l_returnflag"], F.col("_row"))


@query(
    "U1_concatenate",
    "SELECT 'customer' AS side, c_custkey AS key, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier",
)
def concatenated(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return distinct_rows.concatenate({"customer": c, "supplier": s}, "side")


