"""Stateless operators give the same rows on a stream as on a batch."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridspan.operators import compute, filter as f, region, reshape, select, summary, variants
from gridspan.operators.reads import decode_pileup
from gridspan.sources.lines import fields_frame
from gridspan.streaming import live
from tests.conftest import rows


@pytest.fixture
def arrivals(spark, tmp_path):
    """A folder that gets its files one after the other."""
    path = str(tmp_path / "in")

    def add(df):
        df.write.mode("append").parquet(path)
        return path

    return add


def run(stream, tmp_path, name):
    out = str(tmp_path / name)
    live.write_stream(stream, out, str(tmp_path / f"{name}-progress")).awaitTermination()
    return stream.sparkSession.read.parquet(out)


STEPS = {
    "filter": lambda df: f.keep_rows(df, ("POS", ">", 3), ("CHROM", "in", ["a"])),
    "region": lambda df: region.overlap_filter(df, [("a", 2, 9)], ("CHROM", "POS", "stop")),
    "compute": lambda df: compute.compute(df, twice=lambda n: n("POS") * 2),
    "select": lambda df: select.select_columns(df, "POS,CHROM"),
    "expand": lambda df: reshape.expand(df, "INFO", keys=["AF", "DB"]),
    "gt_stats": lambda df: variants.gt_stats(df, ["S1", "S2"]),
    "samples_long": lambda df: variants.samples_long(df, fields={"GT": ("String", "1"), "DP": ("Integer", "1")}, samples=["S1", "S2"]),
    "flatten": lambda df: reshape.flatten(df.select("POS", F.struct("CHROM", F.struct("INFO").alias("x")).alias("s"))),
    "decode_pileup": lambda df: decode_pileup(df.select(F.lit("A").alias("ref"), F.lit(".,+1Gt").alias("bases"), F.lit("III").alias("quals"), "POS")),
}


def records(spark, start, n):
    return spark.range(start, start + n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("CHROM"),
        F.col("id").alias("POS"),
        (F.col("id") + 2).alias("stop"),
        F.concat(F.lit("AF=0."), F.col("id").cast("string"), F.lit(";DB")).alias("INFO"),
        F.lit("GT:DP").alias("FORMAT"),
        F.lit("0/1:3").alias("S1"),
        F.lit("./.:.").alias("S2"),
    )


@pytest.mark.parametrize("name", STEPS)
def test_same_as_batch(spark, arrivals, tmp_path, name):
    arrivals(records(spark, 0, 5))
    path = arrivals(records(spark, 5, 5))
    batch = spark.read.parquet(path)
    stream = live.read_growing(spark, path, batch.schema)
    got = run(live.chain(stream, STEPS[name]), tmp_path, "out")
    assert sorted(rows(got), key=str) == sorted(rows(STEPS[name](batch)), key=str)


def test_later_files_are_added_once(spark, arrivals, tmp_path):
    path = arrivals(records(spark, 0, 4))
    schema = spark.read.parquet(path).schema
    first = run(live.read_growing(spark, path, schema), tmp_path, "out").count()
    arrivals(records(spark, 4, 3))
    second = run(live.read_growing(spark, path, schema), tmp_path, "out").count()
    assert (first, second) == (4, 7)


def test_distinct_with_a_bound_on_state(spark, arrivals, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], "k int, t string")
    path = arrivals(df.withColumn("t", F.col("t").cast("timestamp")))
    schema = spark.read.parquet(path).schema
    out = run(live.live_distinct(live.read_growing(spark, path, schema), ["k"], "t"), tmp_path, "out")
    assert sorted(r["k"] for r in out.collect()) == [1, 2]


def test_streamed_text_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bed").write_text("c\t1\t5\nd\t2\t9\n")
    lines = live.read_growing(spark, str(tmp_path / "in"), "value string", "text").withColumnRenamed("value", "line")
    out = run(fields_frame(lines, [("Chr", "string"), ("Beg", "long"), ("End", "long")]), tmp_path, "out")
    assert sorted(rows(out)) == [("c", 1, 5), ("d", 2, 9)]


KEYS = ["column", "value"]


def counted(spark, path, out, tmp_path, compact):
    stream = live.read_growing(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)
    counts = live.live_value_counts(stream, ["CHROM", "POS"], total=True)
    live.write_totals(counts, out, str(tmp_path / "progress"), KEYS, compact).awaitTermination()


@pytest.mark.parametrize("compact", [1, 2, 16])
def test_totals_survive_a_stop_between_two_writes(spark, arrivals, tmp_path, monkeypatch, compact):
    """A reader sees the result after one batch or after the next; a batch writes only what it changed."""
    out = str(tmp_path / "out")
    shown = lambda: sorted(rows(live.shares_of(live.read_totals(spark, out, KEYS))), key=str)
    want = lambda df: sorted(rows(summary.value_counts_of(df, ["CHROM", "POS"])), key=str)
    path = arrivals(records(spark, 0, 6).coalesce(1))
    counted(spark, path, out, tmp_path, compact)
    before = want(spark.read.parquet(path))
    assert shown() == before

    publish = live._publish

    def stop(*_):
        raise RuntimeError("stopped before the result is published")

    for attempt in range(2):
        if not attempt:
            arrivals(records(spark, 5, 3).coalesce(1))
        monkeypatch.setattr(live, "_publish", stop)
        with pytest.raises(StreamingQueryException):
            counted(spark, path, out, tmp_path, compact)
        assert shown() == before
    monkeypatch.setattr(live, "_publish", publish)
    counted(spark, path, out, tmp_path, compact)
    assert shown() == want(spark.read.parquet(path))
    changed = spark.read.parquet(f"{out}/changes").where("batch = 1")
    # three positions, two chromosomes and the total; the five positions before are not written again
    assert changed.count() == 6

    # published, but not known to be: the batch comes again and is left alone
    arrivals(records(spark, 0, 2).coalesce(1))
    monkeypatch.setattr(live, "_publish", lambda *a: (publish(*a), stop()))
    with pytest.raises(StreamingQueryException):
        counted(spark, path, out, tmp_path, compact)
    after = want(spark.read.parquet(path))
    assert shown() == after
    monkeypatch.setattr(live, "_publish", publish)
    counted(spark, path, out, tmp_path, compact)
    assert shown() == after


def test_totals_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing is published"):
        live.read_totals(spark, str(tmp_path / "none"), KEYS)
