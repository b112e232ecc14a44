"""Plans are the ones wanted: pushdown, pruning, top-k, no shuffle of the large side."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gridspan.operators import filter as f
from gridspan.operators import interval_layout, intervals, order, region, summary, variants
from gridspan.plans import joins
from gridspan.plans.position import text_lines
from gridspan.suite.base import genotypes, intervals as spans, table, windows
from tests.oracle import plan


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_filters_and_columns_reach_the_scan(spark, sf):
    df = table(spark, sf, "lineitem")
    kept = f.keep_rows(df, ("l_returnflag", "in", ["A", "R"]), ("l_tax", ">", 0.05), ("l_shipdate", ">=", "1998-01-01"))
    text = plan(kept.select("l_orderkey"))
    pushed = re.search(r"PushedFilters: \[(.*)\], ReadSchema", text).group(1)
    assert "In(l_returnflag" in pushed and "GreaterThan(l_tax,0.05)" in pushed and "GreaterThanOrEqual(l_shipdate" in pushed
    assert "l_partkey" not in text


def test_region_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1, 5), ("b", 2, 9)], "chrom string, start long, end long")
    intervals.sorted_layout(df).write.parquet(path)
    text = plan(region.pruned_overlap_filter(spark.read.parquet(path), [("a", 3, 7)]))
    for part in ("EqualTo(chrom,a)", "LessThan(start,7)", "GreaterThan(end,3)", "GreaterThan(MaxEndSoFar,3)"):
        assert part in text


def test_both_spellings_of_a_chromosome_reach_the_scan(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("chrom"), F.col("o_orderkey").alias("start"), F.col("o_custkey").alias("end")
    )
    text = plan(region.overlap_filter(df, [("chr2", None, 9), ("alt", 3, None)], alias=True))
    assert "In(o_orderstatus, [2,chr2])" in text and "EqualTo(o_orderstatus,alt)" in text


def test_tail_and_top_are_top_k(spark, sf):
    df = table(spark, sf, "orders")
    assert "TakeOrderedAndProject" in plan(order.tail(df, 10, F.col("o_orderkey")))
    assert "TakeOrderedAndProject" in plan(order.top(df, ["o_totalprice:desc"], 5))
    assert "TakeOrderedAndProject" in plan(order.sample(df, 100, ["o_orderkey"]))


def test_few_windows_do_not_shuffle_the_rows(spark, sf):
    text = plan(region.overlap_join(spans(spark, sf), windows(spark, sf)))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_many_windows_are_joined_by_cell(spark, sf, monkeypatch):
    monkeypatch.setattr(region, "fits_broadcast", lambda *a, **k: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(region.overlap_join(spans(spark, sf), windows(spark, sf)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(_c#\d+, _cell#\d+L?, _salt#\d+", text)


def test_genotypes_need_no_shuffle_and_no_python(spark, sf):
    df = genotypes(spark, sf)
    before, after = plan(df), plan(variants.gt_stats(df))
    assert after.count("Exchange") == before.count("Exchange") and "Python" not in after


def test_value_counts_aggregate_before_the_shuffle(spark, sf):
    assert "partial_count" in plan(summary.value_counts(table(spark, sf, "lineitem"), "l_returnflag"))


def test_lines_are_not_shuffled(spark, lines):
    text = plan(text_lines(spark, lines("a.txt", "x\ny\n")))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning(file" not in text


def test_size_check(spark):
    df = spark.range(1000).select("id", F.lit("x" * 100).alias("t"))
    assert joins.fits_broadcast(df) and not joins.fits_broadcast(df, rows=999) and not joins.fits_broadcast(df, size=50_000)


def test_skewed_rows_are_split(spark):
    """Copies of one row that share a cell and a salt: Spark splits their partition."""
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    try:
        left = spark.range(0, 400000, 1, 16).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"), "id")
        right = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = left.join(right, "k")
        assert joined.agg(F.count("*")).first()[0] == 400000
        joined.collect()
        assert "skew=true" in plan(joined)
    finally:
        for key in ("adaptive.skewJoin.skewedPartitionThresholdInBytes", "adaptive.advisoryPartitionSizeInBytes", "autoBroadcastJoinThreshold", "adaptive.skewJoin.skewedPartitionFactor"):
            spark.conf.unset(f"spark.sql.{key}")


def _scans(node) -> list:
    """The file scans below a finished plan."""
    name = node.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _scans(node.executedPlan())
    if name.endswith("QueryStageExec"):
        return _scans(node.plan())
    if name == "FileSourceScanExec":
        return [node]
    children = node.children()
    return [s for i in range(children.size()) for s in _scans(children.apply(i))]


def test_a_join_with_windows_prunes_folders_while_it_runs(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"{1 + i % 3}", a, a + rng.randrange(0, 300), i) for i, a in enumerate(rng.randrange(0, 200_000) for _ in range(4000))]
    rows += [("1", 500, 150_000, -1), ("2", 70_000, 70_000, -2), (None, 5, 9, -3), ("X", 100, 200, -4)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long, id long")
    path = str(tmp_path / "layout")
    interval_layout.write_layout(df, path, bits=12, file_rows=50)
    wins = [("1", a, a + 40, i) for i, a in enumerate(range(100_000, 140_000, 40))] + [("2", 69_990, 70_010, 1000), ("X", None, 101, 1001), ("Y", 0, 9, 1002)]
    windows = spark.createDataFrame(wins, "chrom string, start long, end long, window_id long")
    assert len(wins) > 1000
    got = interval_layout.layout_overlap_join(spark, path, windows)
    want = region.overlap_join(df, windows)
    assert sorted(map(tuple, got.select("id", "window_id").collect())) == sorted(map(tuple, want.select("id", "window_id").collect()))
    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.queryExecution().toRdd().count()
    scan = [s for s in _scans(plan) if "LayoutBin" in s.toString()]
    assert scan and "dynamicpruning" in scan[0].toString()
    files = sum(1 for _ in (tmp_path / "layout").rglob("LayoutChrom=*/LayoutBin=*/*.parquet"))
    read = scan[0].metrics().apply("numFiles").value()
    assert 0 < read < files / 3
    any_mode = interval_layout.layout_overlap_join(spark, path, windows, "any")
    assert sorted(r["id"] for r in any_mode.collect()) == sorted(r["id"] for r in region.overlap_join(df, windows, "any").collect())
    assert interval_layout.read_layout(spark, path).count() == len(rows)
    assert dict(interval_layout.read_layout(spark, path).dtypes)["LayoutChrom"] == "string"


def test_layout_keeps_to_a_number_of_folders(spark, sf, tmp_path, monkeypatch):
    """Ten times the bins are no more folders, and the join gives the same rows."""
    monkeypatch.setattr(interval_layout, "MAX_FOLDERS", 16)
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 7).alias("end"), "id")
    wins = spark.range(50).select(F.lit("a").alias("chrom"), (F.col("id") * 300).alias("start"), (F.col("id") * 300 + 40).alias("end"), F.col("id").alias("window_id"))
    path = str(tmp_path / "folders")
    interval_layout.write_layout(df, path, bits=4)
    assert 8 <= sum(1 for _ in (tmp_path / "folders").glob("LayoutChrom=*/LayoutBin=*")) <= 16
    got, want = interval_layout.layout_overlap_join(spark, path, wins), region.overlap_join(df, wins)
    pairs = lambda found: sorted((r["id"], r["window_id"]) for r in found.collect())
    assert pairs(got) == pairs(want)
