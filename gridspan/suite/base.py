"""Registry of checked queries: each runs over whole tables, most with a SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spread import spread
from ..session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that gives the same rows."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shares(df: DataFrame, *columns: str, digits: int = 7) -> DataFrame:
    """Sums of doubles differ in the last bits with the order of addition; compare rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# The derived shapes: intervals from line items, windows and genotypes from orders.

INTERVALS_SQL = (
    "SELECT l_returnflag AS chrom, l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS \"end\", "
    "l_linenumber, l_partkey, l_suppkey, l_discount AS value FROM lineitem"
)
WINDOWS_SQL = (
    "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS chrom, o_orderkey AS start, "
    "o_orderkey + 5 + o_custkey % 90 AS \"end\", o_orderkey AS window_id FROM orders WHERE o_custkey % 50 < 5"
)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("chrom"),
        F.col("l_orderkey").alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_discount").alias("value"),
    )


def windows(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    chrom = F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R")
    return (
        table(spark, sf, "orders")
        .where(F.col("o_custkey") % 50 < 5)
        .select(
            chrom.alias("chrom"),
            key.alias("start"),
            (key + 5 + F.col("o_custkey") % 90).alias("end"),
            key.alias("window_id"),
        )
    )


CALLS = ("0/0", "0/1", "1/1", "./.", "1|2", "0", ".")


def genotypes(spark: SparkSession, sf: str, samples: int = 4) -> DataFrame:
    """A variant table: one record per order, packed GT:AD:DP cells by a rule on the customer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    calls = F.array(*[F.lit(c) for c in CALLS])

    def cell(i: int) -> Column:
        call = F.get(calls, ((cust + i * 3) % len(CALLS)).cast("int"))
        packed = F.concat_ws(
            ":",
            call,
            F.concat_ws(",", ((cust + i) % 30).cast("string"), ((key + i) % 20).cast("string")),
            ((cust + key + i) % 40).cast("string"),
        )
        # every tenth sample is a lone dot
        return F.when((key + i) % 10 == 0, ".").otherwise(packed)

    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")).select(
        F.col("o_orderstatus").alias("CHROM"),
        key.alias("POS"),
        F.lit("GT:AD:DP").alias("FORMAT"),
        *[cell(i).alias(f"S{i}") for i in range(1, samples + 1)],
    )


FORMAT_FIELDS = {"GT": ("String", "1"), "AD": ("Integer", "R"), "DP": ("Integer", "1")}


def genotypes_sql(samples: int = 4) -> str:
    """One row per record and sample: gt, ad0, ad1, dp, null for a lone dot."""
    calls = "[" + ", ".join(f"'{c}'" for c in CALLS) + "]"
    parts = [
        f"SELECT o_orderkey, o_custkey, o_orderstatus, {i} AS i, 'S{i}' AS sample, (o_orderkey + {i}) % 10 = 0 AS lone, "
        f"{calls}[CAST((o_custkey + {i * 3}) % {len(CALLS)} AS INTEGER) + 1] AS gt, (o_custkey + {i}) % 30 AS ad0, "
        f"(o_orderkey + {i}) % 20 AS ad1, (o_custkey + o_orderkey + {i}) % 40 AS dp FROM orders"
        for i in range(1, samples + 1)
    ]
    return "(" + " UNION ALL ".join(parts) + ")"


def written_text(lines: DataFrame, name: str, codec: str | None = None) -> str:
    """Write a one-column frame of text (a row may be several lines) and return its path."""
    path = scratch_path(lines.sparkSession, name)
    writer = lines.write if codec is None else lines.write.option("compression", codec)
    writer.text(path)
    return path


def line(*parts: Column, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[p.cast("string") for p in parts])
